"""Single operators, each DataFrame in, DataFrame out."""
