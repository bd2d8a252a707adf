"""Quality rules and robust multivariate outliers (operator 7).

Statistics of a document are made where it is read. Per language and source, a minimum-covariance-
determinant estimate is found by concentration steps over all documents: take the half that lies
nearest, take mean and covariance of that half, and again until the determinant of the covariance no
longer falls. A group takes several starts, made of a small part of it, and keeps the end with the least
determinant; a group that is through takes no further part. The distances are then brought to the scale
of the group's own median, documents within a chi-squared quantile of it give the last mean and
covariance, and documents far beyond that are rejected. Documents of small groups are judged by an
estimate of their language, those of small languages by one of all documents.

A group of bounded size takes its steps in one task; in a larger one they are jobs over all its
documents. Only sums per group leave a task there: counts, sums and products of the statistics, and counts of
distances by bin. So a group with most documents costs no more than the others. Distances that agree
to one part in 4,096 count as ties, and the tied documents at the edge of the half share what is left
of it, each with the same weight, so that the half is exact and does not depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations_with_replacement
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetmill.llm.common import drop_written, slices, written
from fleetmill.operators.ordered import split_heavy

#: Base rules.
LEAST_WORDS, MOST_REPEATED_PERCENT, WINDOW = 20, 30, 8
SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\v\f\r"
#: Share of a group that an estimate is made of.
HALF = 0.5
#: A step has to lower the logarithm of the determinant by this much, or the group is through. So
#: steps end by themselves.
FALL = 1e-4
#: Documents of a group that its starts are made of, those with the least hashes; random starts, each
#: from one document more than there are statistics; those followed to their end on these documents;
#: and those then followed on the whole group.
SAMPLE, TRIED, FOLLOWED, STARTS = 500, 100, 10, 2
#: Chi-squared quantiles of seven statistics at 0.5 and 0.975, and what the covariance of normal
#: statistics within the latter has to be multiplied by.
MEDIAN, WITHIN, WITHIN_FACTOR = 6.346, 16.013, 1.045
#: Groups of fewer documents that pass the base rules are judged by a wider group.
LEAST_GROUP = 50
#: Squared distance beyond which a document is rejected, per statistic. The transformed statistics
#: are not normal, so the bound lies far outside a chi-squared quantile: 10 standard deviations.
CUTOFF = 100.0
#: Added to every variance, so that a statistic that is the same for most documents stays usable.
RIDGE = 1e-2
#: Bits of a squared distance that its bin leaves out: 12 of its fraction stay.
BIN_SHIFT = 40
#: A group of at most so many documents is taken through all its steps by one task, 6 MB of numbers. A
#: step of larger ones is a few jobs, whatever their size.
WHOLE_ROWS = 100_000
#: Documents packed into one row, at most.
BLOCK = 1_024


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of eight words that are found twice or more in the text."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    # Rows of equal numbers are equal windows: pairs are numbered, pairs of those, and again.
    codes = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    step = 1
    while step < WINDOW:
        pairs = codes[:-step] * np.int64(len(words) + 1) + codes[step:]
        values, codes, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        if len(values) == len(pairs):
            return 0
        step *= 2
    repeated = counts[codes] > 1
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, np.flatnonzero(repeated), 1)
    np.add.at(covered, np.flatnonzero(repeated) + WINDOW, -1)
    return int((np.cumsum(covered)[:-1] > 0).sum())


def statistics_of(text: str) -> tuple:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``, then what MCD sees besides."""
    words = text.encode("utf-8", "surrogatepass").split()
    spaces = sum(map(text.count, _SPACES))
    lines = [x for x in text.split("\n") if x.strip(_SPACES)]
    return (
        len(words),
        len(text) - spaces,
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(set(words)),
        sum(map(text.count, ".!?")),
        sum(map(eq, words, words[1:])),
    )


_NAMES = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_distinct",
    "n_stops",
    "n_stutters",
)


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source`` and the statistics of every row."""
    schema = "doc_id bigint, lang string, source string, " + ", ".join(f"{n} bigint" for n in _NAMES)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = [statistics_of(x or "") for x in batch.column("text").to_pylist()]
            columns = [batch.column(n) for n in ("doc_id", "lang", "source")]
            columns += [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang", "source", *_NAMES])

    own = docs.select(
        docs["doc_id"].cast("bigint").alias("doc_id"),
        docs["lang"].cast("string").alias("lang"),
        docs["source"].cast("string").alias("source"),
        "text",
    )
    return own.mapInArrow(take, schema)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED_PERCENT
    )


def _vector() -> list[Column]:
    """Transformed statistics: rates, with roots and logarithms against their skew."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    lines = F.greatest(F.col("n_lines"), F.lit(1)).cast("double")
    return [
        F.col("word_chars") / words,
        F.sqrt(F.col("n_symbols") / words) * 10,
        F.sqrt(F.col("n_dup_lines") / lines) * 2,
        F.sqrt(F.col("n_repeat_words") / words) * 2,
        F.sqrt(F.col("n_stutters") / words) * 10,
        F.log(F.col("n_distinct") + 1.0) - 0.9 * F.log(words + 1.0),
        F.log((F.col("n_stops") + 1.0) / words),
    ]


#: Number of transformed statistics.
_DIM = 7
_X = [f"x{i}" for i in range(_DIM)]
_PAIRS = list(combinations_with_replacement(range(_DIM), 2))


def with_ridge(cov: np.ndarray, n: float) -> np.ndarray:
    """``cov`` as it is inverted. That of fewer rows than elsewhere is drawn towards ones."""
    return cov + (RIDGE + max(1 - n / (HALF * LEAST_GROUP), 0)) * np.eye(_DIM)


def distances(x: np.ndarray, mean: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    off = x - mean
    return np.maximum(((off @ inverse) * off).sum(axis=1), 0)


def _estimate(x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Logarithm of the determinant, mean and inverse for rows that count alike."""
    cov = with_ridge(np.cov(x, rowvar=False, bias=True), len(x))
    return float(np.linalg.slogdet(cov)[1]), x.mean(axis=0), np.linalg.inv(cov)


def _concentrated(x: np.ndarray, mean: np.ndarray, inverse: np.ndarray):
    near = np.argsort(distances(x, mean, inverse), kind="stable")[: -(-len(x) // 2)]
    return _estimate(x[near])


def starts(x: np.ndarray) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """The best ends of concentration steps on a few rows, at most ``STARTS``.

    The first start are the medians and median absolute deviations, the others random rows of a fixed seed.
    """
    x = x[np.lexsort(x.T)]
    centre = np.median(x, axis=0)
    spread = (1.4826 * np.median(np.abs(x - centre), axis=0)) ** 2
    begun = [(0.0, centre, np.linalg.inv(with_ridge(np.diag(spread), len(x) * HALF)))]
    rng = np.random.default_rng(0)
    for _ in range(TRIED):
        begun.append(_estimate(x[rng.permutation(len(x))[: _DIM + 1]]))
    for _ in range(2):
        begun = [_concentrated(x, *b[1:]) for b in begun]
    ends: list[tuple[float, np.ndarray, np.ndarray]] = []
    for now in sorted(begun, key=lambda b: b[0])[:FOLLOWED]:
        while (after := _concentrated(x, *now[1:]))[0] < now[0] - FALL:
            now = after
        if all(abs(now[0] - e[0]) > FALL for e in ends):
            ends.append(now)
    return sorted(ends, key=lambda e: e[0])[:STARTS]


_KEY = ["grp", "start"]
_STATE = "grp string, start int, mean array<double>, inverse array<double>, det double, active boolean"
_SUMS = ["n", *(f"s{i}" for i in range(_DIM)), *(f"c{i}_{j}" for i, j in _PAIRS)]


def _first_state(rows: DataFrame) -> DataFrame:
    """Starts of every group. Their determinants are of a part of it and do not count."""

    def find(table: pa.Table) -> pa.Table:
        x = np.stack([table.column(n).to_numpy() for n in _X], axis=1)
        found = starts(x)
        columns = {
            "grp": [table.column("grp")[0].as_py()] * len(found),
            "start": pa.array(range(len(found)), pa.int32()),
            "mean": [list(m) for _, m, _ in found],
            "inverse": [list(i.ravel()) for _, _, i in found],
            "det": [float("inf")] * len(found),
            "active": [True] * len(found),
        }
        return pa.table(columns)

    order = Window.partitionBy("grp").orderBy(F.xxhash64("doc_id", *_X), *_X)
    few = rows.withColumn("at", F.row_number().over(order)).where(F.col("at") <= SAMPLE)
    return few.select("grp", *_X).groupBy("grp").applyInArrow(find, _STATE)


def _blocks(rows: DataFrame) -> DataFrame:
    """``(grp, x)``: the statistics of up to ``BLOCK`` rows of a group that lie in one partition."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in _X], axis=1)
            groups = batch.column("grp").to_pylist()
            cuts = [0]
            for i in range(1, len(groups)):
                if groups[i] != groups[i - 1] or i - cuts[-1] >= BLOCK:
                    cuts.append(i)
            packed = [x[i:j].tobytes() for i, j in zip(cuts, [*cuts[1:], len(groups)], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([groups[i] for i in cuts]), pa.array(packed, pa.binary())], ["grp", "x"]
            )

    return rows.select("grp", *_X).sortWithinPartitions("grp").mapInArrow(pack, "grp string, x binary")


def _measured(batch: pa.RecordBatch) -> Iterator[tuple[str, dict, np.ndarray, np.ndarray]]:
    """Per block and estimate of its group: the group, the estimate, offsets, squared distances."""
    columns = (batch.column(n).to_pylist() for n in ("grp", "x", "known"))
    for grp, packed, known in zip(*columns, strict=True):
        x = np.frombuffer(packed, np.float64).reshape(-1, _DIM)
        for one in known:
            mean, inverse = np.array(one["mean"]), np.array(one["inverse"]).reshape(_DIM, _DIM)
            yield grp, one, x - mean, distances(x, mean, inverse)


def _with_known(blocks: DataFrame, state: DataFrame, *more: str) -> DataFrame:
    known = F.collect_list(F.struct("start", "mean", "inverse", *more))
    return blocks.join(state.groupBy("grp").agg(known.alias("known")), "grp")


def _edges(blocks: DataFrame, state: DataFrame) -> DataFrame:
    """``(grp, start, edge, share)``: the bin in which the half ends, and the weight of what is in it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for grp, one, _, d2 in _measured(batch):
                bins, n = np.unique(d2.view(np.int64) >> BIN_SHIFT, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([grp] * len(n)),
                        pa.array([one["start"]] * len(n), pa.int32()),
                        pa.array(bins),
                        pa.array(n),
                    ],
                    [*_KEY, "bin", "n"],
                )

    counted = _with_known(blocks, state).mapInArrow(count, "grp string, start int, bin bigint, n bigint")
    whole = Window.partitionBy(*_KEY)
    binned = counted.groupBy(*_KEY, "bin").agg(F.sum("n").alias("n"))
    binned = binned.withColumn("upto", F.sum("n").over(whole.orderBy("bin")))
    left = F.ceil(F.sum("n").over(whole) * HALF) - F.col("upto") + F.col("n")
    binned = binned.withColumn("left", left).where("left > 0 and left <= n")
    return binned.select(*_KEY, F.col("bin").alias("edge"), (F.col("left") / F.col("n")).alias("share"))


def _weights(d2: np.ndarray, edge: int, share: float, reweighted: bool) -> np.ndarray:
    """What rows count: those of the nearest half, or those within the chi-squared quantile."""
    if reweighted:
        median = float(np.int64((edge + 1) << BIN_SHIFT).view(np.float64))
        return (d2 <= WITHIN * max(median / MEDIAN, 1.0)).astype(np.float64)
    bins = d2.view(np.int64) >> BIN_SHIFT
    return (bins < edge) + share * (bins == edge)


def _summed(off: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The values of ``_SUMS``."""
    products = (off * weight[:, None]).T @ off
    return np.concatenate([[weight.sum()], weight @ off, products[np.triu_indices(_DIM)]])


def _renewed(sums: np.ndarray, mean: np.ndarray, factor: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Logarithm of the determinant, mean and inverse that sums of offsets from ``mean`` give."""
    n, first = sums[0], sums[1 : _DIM + 1] / sums[0]
    cov = np.zeros((_DIM, _DIM))
    for (i, j), product in zip(_PAIRS, sums[_DIM + 1 :], strict=True):
        cov[i, j] = cov[j, i] = product / n - first[i] * first[j]
    cov = with_ridge(cov * factor, n)
    return float(np.linalg.slogdet(cov)[1]), mean + first, np.linalg.inv(cov)


def _sums(blocks: DataFrame, state: DataFrame, edges: DataFrame, reweighted: bool) -> DataFrame:
    """Per group and start the weighted sums and products of offsets from its mean.

    Of the nearest half; or, ``reweighted``, of what lies within the chi-squared quantile.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple[str, int], np.ndarray] = {}
            for grp, one, off, d2 in _measured(batch):
                row = _summed(off, _weights(d2, one["edge"], one["share"], reweighted))
                key = (grp, one["start"])
                sums[key] = sums[key] + row if key in sums else row
            if sums:
                table = np.stack(list(sums.values()))
                columns = [pa.array([k[0] for k in sums]), pa.array([k[1] for k in sums], pa.int32())]
                columns += [pa.array(table[:, i]) for i in range(len(_SUMS))]
                yield pa.RecordBatch.from_arrays(columns, [*_KEY, *_SUMS])

    schema = "grp string, start int, " + ", ".join(f"{c} double" for c in _SUMS)
    known = _with_known(blocks, state.join(edges, _KEY), "edge", "share")
    return known.mapInArrow(add, schema).groupBy(*_KEY).agg(*(F.sum(c).alias(c) for c in _SUMS))


def _advanced(state: DataFrame, sums: DataFrame, factor: float, fall: float) -> DataFrame:
    """``state`` with the estimates that ``sums`` give where the determinant falls by ``fall``."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                n = row["n"]
                if not row["active"] or not n:
                    row["active"] = False
                    continue
                sums = np.array([row[c] for c in _SUMS])
                det, mean, inverse = _renewed(sums, np.array(row["mean"]), factor)
                row["active"] = det < row["det"] - fall
                if row["active"]:
                    row["mean"], row["inverse"], row["det"] = list(mean), list(inverse.ravel()), det
            names = [*_KEY, "mean", "inverse", "det", "active"]
            types = [pa.string(), pa.int32(), *[pa.list_(pa.float64())] * 2, pa.float64(), pa.bool_()]
            columns = [pa.array([r[k] for r in rows], t) for k, t in zip(names, types, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return state.join(sums, _KEY, "left").mapInArrow(take, _STATE)


def _step(
    x: np.ndarray, mean: np.ndarray, inverse: np.ndarray, factor: float = 1.0, reweighted: bool = False
) -> tuple[float, np.ndarray, np.ndarray]:
    """A step over all rows of a group at once."""
    d2 = distances(x, mean, inverse)
    bins, n = np.unique(d2.view(np.int64) >> BIN_SHIFT, return_counts=True)
    left = -(-len(x) // 2) - np.cumsum(n) + n
    last = np.flatnonzero((left > 0) & (left <= n))[0]
    weight = _weights(d2, bins[last], left[last] / n[last], reweighted)
    return _renewed(_summed(x - mean, weight), mean, factor)


def estimate_of(x: np.ndarray, few: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and inverse of a group that one task holds; its starts are made of ``few`` of its rows."""
    ends = []
    for _, mean, inverse in starts(few):
        now = (float("inf"), mean, inverse)
        while (after := _step(x, *now[1:]))[0] < now[0] - FALL:
            now = after
        ends.append(now)
    return _step(x, *min(ends, key=lambda e: e[0])[1:], WITHIN_FACTOR, reweighted=True)[1:]


def _estimates_of_whole(rows: DataFrame) -> DataFrame:
    """Estimates of groups of at most ``WHOLE_ROWS`` documents."""

    def find(table: pa.Table) -> pa.Table:
        x = np.stack([table.column(n).to_numpy() for n in _X], axis=1)
        few = np.lexsort([*x.T[::-1], table.column("hash").to_numpy()])[:SAMPLE]
        mean, inverse = estimate_of(x, x[few])
        columns = {"grp": table.column("grp")[:1], "mean": [list(mean)], "inverse": [list(inverse.ravel())]}
        return pa.table(columns)

    own = rows.select("grp", *_X, F.xxhash64("doc_id", *_X).alias("hash"))
    return own.groupBy("grp").applyInArrow(find, "grp string, mean array<double>, inverse array<double>")


def estimates(rows: DataFrame) -> DataFrame:
    """``(grp, mean, inverse)`` of the documents ``rows (grp, doc_id, x0 …)``, one row per group.

    Groups below 50 documents occur only where there are no more in all.
    """
    rows = written(rows.select("grp", "doc_id", *_X), "members")
    whole, spread = split_heavy(rows, ["grp"], WHOLE_ROWS)
    found = _estimates_of_whole(whole)
    if spread is not None:
        found = found.unionByName(_estimates_of_spread(spread))
    found = written(found, "estimates")
    drop_written(rows)
    return found


def _estimates_of_spread(rows: DataFrame) -> DataFrame:
    """Estimates of groups of any size, step by step over blocks of their documents."""
    blocks = written(_blocks(rows), "blocks")
    state = written(_first_state(rows), "state")
    while not (active := state.where("active")).isEmpty():
        edges = written(_edges(blocks, active), "edges")
        sums = _sums(blocks, active, edges, reweighted=False)
        before, state = state, written(_advanced(state, sums, 1.0, FALL), "state")
        drop_written(before)
        drop_written(edges)
    best = F.min(F.struct("det", "start", "mean", "inverse")).alias("b")
    least = state.groupBy("grp").agg(best).select("grp", "b.start", "b.mean", "b.inverse")
    least = written(least.withColumns({"det": F.lit(float("inf")), "active": F.lit(True)}), "state")
    edges = written(_edges(blocks, least), "edges")
    sums = _sums(blocks, least, edges, reweighted=True)
    return _advanced(least, sums, WITHIN_FACTOR, 0.0).select("grp", "mean", "inverse")


def _with_distance(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """``rows`` with the squared distance ``d2`` from the estimate of their group, null without one."""
    joined = rows.join(estimates, "grp", "left")
    off = [F.col(x) - F.col("mean")[i] for i, x in enumerate(_X)]
    terms = [
        off[i] * off[j] * F.col("inverse")[i * _DIM + j] * (1 if i == j else 2) for i, j in _PAIRS
    ]
    return joined.withColumn("d2", reduce(lambda a, b: a + b, terms)).drop("mean", "inverse")


def levels(rows: DataFrame) -> DataFrame:
    """``(lang, source, level, needed)``: by which level a group is judged, and those it helps to find.

    A language's documents all count for its estimate if one of its sources is small, all documents
    for the widest one if one of the languages is.
    """
    groups = rows.groupBy("lang", "source").agg(F.count("*").alias("n"))
    groups = written(groups, "groups")
    langs = groups.groupBy("lang").agg(F.sum("n").alias("all"), F.min("n").alias("least"))
    langs = written(langs, "languages").withColumnRenamed("lang", "l")
    small = langs.where((F.col("least") < LEAST_GROUP) & (F.col("all") < LEAST_GROUP))
    widest = F.lit(not small.isEmpty())
    found = groups.join(langs, groups["lang"].eqNullSafe(langs["l"]))
    enough, helps = F.col("all") >= LEAST_GROUP, F.col("least") < LEAST_GROUP
    level = F.when(F.col("n") >= LEAST_GROUP, 0).when(enough, 1).otherwise(2)
    needed = F.array(
        F.when(F.col("n") >= LEAST_GROUP, 0), F.when(enough & helps, 1), F.when(widest, 2)
    )
    found = found.select("lang", "source", level.alias("level"), F.array_compact(needed).alias("needed"))
    return written(found, "levels")


def _of_level(rows: DataFrame, levels: DataFrame, level: str) -> DataFrame:
    """``rows`` with ``grp``, the key of their group at ``level``, a column of ``levels``.

    An estimate is for all documents (level 2), a language (1), or a language and source (0).
    """
    told = levels.select(F.col("lang").alias("l"), F.col("source").alias("s"), F.col(level).alias("at"))
    same = rows["lang"].eqNullSafe(told["l"]) & rows["source"].eqNullSafe(told["s"])
    joined = rows.join(told, same, "left").drop("l", "s")
    at = F.explode("at") if level == "needed" else F.col("at")
    joined = joined.withColumn("level", at).drop("at")
    lang, source = F.when(F.col("level") < 2, F.col("lang")), F.when(F.col("level") < 1, F.col("source"))
    # Nulls are left out, so a group without a language has a key of its own.
    key = F.to_json(F.struct("level", lang.alias("lang"), source.alias("source")))
    return joined.withColumn("grp", key)


def judge(docs: DataFrame) -> DataFrame:
    """``doc_id``, the base statistics, ``base_failed`` and ``kept``, one row per row of ``docs``.

    Null and empty texts have no words and fail the base rules. Null languages and sources are a
    group like any other. Groups with fewer than ``LEAST_GROUP`` documents that pass the base rules
    are judged by the estimate of their language, and if that has fewer, of all documents. Repeated
    rows count each and are judged alike; null ids stay null.
    No documents, no rows. Other columns are not read.
    """
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    own = statistics(docs).withColumn("base_failed", base_failed())
    own = own.withColumns(dict(zip(_X, _vector(), strict=True)))
    own = written(own.select("doc_id", "lang", "source", *base, "base_failed", *_X), "statistics")
    passed = own.where("not base_failed")
    found = levels(passed)
    measured = _with_distance(_of_level(own, found, "level"), estimates(_of_level(passed, found, "needed")))
    far = F.coalesce(F.col("d2") > CUTOFF * _DIM, F.lit(False))
    return measured.select("doc_id", *base, "base_failed", (~F.col("base_failed") & ~far).alias("kept"))
