"""A Merkle manifest of a corpus, and multiproofs of many leaves at once (operator 11).

Every row is a leaf. The leaves of a source, in order of their ids, are the lowest level of a tree of
its own; the roots of all sources, in order of their names, are the lowest level of the tree on top.
A run of sixteen neighbouring nodes becomes one node of the next level, until one node remains.

Proofs are made for whole partitions of leaves. A partition knows its leaves, and so which nodes of
each level follow from them; it names the least set of further nodes without which the runs on the
way to the root cannot be filled (an octopus multiproof), fetches them in one join, and derives all
nodes above from both. The proof of a single leaf is then put together on the spot: what hangs above
a node is the same for all leaves below it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetmill.llm.common import written
from fleetmill.operators.ordered import number_rows
from fleetmill.session import shuffle_partitions

#: Nodes that become one node of the next level.
ARITY = 16
_SHIFT = 4
#: Leaves of a partition, about: what one task holds when it makes proofs.
PARTITION_LEAVES = 50_000
#: The number of the tree over all sources; those of sources count from zero.
TOP = -1

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """Lowercase hex SHA-256 of the fields, each with its length; a null is not an empty text."""
    return F.sha2(F.concat(*map(_field, (doc_id, source, lang, n_chars, text))), 256)


def is_tampered(doc_id: Column) -> Column:
    """Rows with whose text the verification is tried out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


@dataclass(frozen=True)
class Manifest:
    """Leaves with their places, nodes of all levels, and the root of all.

    ``leaves (part, tree, pos, n, doc_id, source, leaf, claimed)``: ``pos`` of ``n`` leaves of the
    tree; ``part`` is the partition whose proofs are made together. ``nodes (tree, level, idx,
    digest)``; the tree of a source has its number in the order of names, ``TOP`` is over all.
    """

    leaves: DataFrame
    nodes: DataFrame
    trees: int
    root: str | None


def build(docs: DataFrame) -> Manifest:
    """The manifest of ``docs (doc_id, source, lang, n_chars, text)``; other columns are left out.

    A column ``claimed`` is kept with each leaf: its digest with the text's A to Z in lower case for
    some rows, the digest itself for the others. Rows without a source are a source of their own,
    the first; rows without an id come first in their source. Rows of one id are ordered by their
    digests; equal rows are leaves of their own. Without rows there are no nodes and no root.
    """
    spark = docs.sparkSession
    names = ("doc_id", "source", "lang", "n_chars", "text")
    own = [docs[c] for c in names]
    lowered = F.translate(docs["text"], _UPPER, _LOWER)
    claimed = F.when(is_tampered(docs["doc_id"]), leaf_digest(*own[:4], lowered))
    leaf = leaf_digest(*own)
    hashed = written(
        docs.select(
            docs["doc_id"].cast("bigint").alias("doc_id"),
            docs["source"].cast("string").alias("source"),
            F.unhex(leaf).alias("leaf"),
            F.unhex(claimed).alias("claimed"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "leaves",
    )
    # The row's own number comes last, so that very many equal rows spread over partitions too.
    order = ["source", "doc_id", "leaf", "row"]
    parts = max(shuffle_partitions(spark), hashed.count() // PARTITION_LEAVES + 1)
    ranged = hashed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    placed = written(ranged.drop("row").withColumn("at", at), "placed")
    placed = placed.withColumn("part", F.shiftright("at", 33))
    segments = placed.groupBy("part", "source").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    # At most one row per partition and source; partitions are in the order of sources.
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    segments = segments.withColumns(
        {
            "start": F.coalesce(F.sum("rows").over(before), F.lit(0)),
            "n": F.sum("rows").over(Window.partitionBy("source")),
        }
    )
    sources = written(segments.select("source", "n").distinct(), "sources")
    numbered = written(number_rows(sources, ["source"], "tree"), "numbered_sources")
    trees = numbered.count()
    segments = written(
        segments.join(
            numbered.select(F.col("source").alias("name"), F.col("tree").cast("bigint").alias("tree")),
            F.col("source").eqNullSafe(F.col("name")),
        ).select(F.col("part").alias("in_part"), F.col("source").alias("of"), "first", "start", "n", "tree"),
        "segments",
    )
    same = (F.col("part") == F.col("in_part")) & F.col("source").eqNullSafe(F.col("of"))
    leaves = written(
        placed.join(segments, same).select(
            "part",
            "tree",
            (F.col("at") - F.col("first") + F.col("start")).alias("pos"),
            "n",
            "doc_id",
            "source",
            "leaf",
            F.coalesce("claimed", "leaf").alias("claimed"),
        ),
        "placed_leaves",
    )
    base = leaves.select("tree", F.col("pos").alias("idx"), F.col("leaf").alias("digest"), "n")
    levels = _levels(base, numbered.agg(F.max("n")).first()[0] or 0)
    roots = levels.where("n = 1").select(
        F.lit(TOP).cast("bigint").alias("tree"), F.col("tree").alias("idx"), "digest"
    )
    top = _levels(written(roots.withColumn("n", F.lit(trees).cast("bigint")).withColumn("level", F.lit(0)), "top"), trees)
    nodes = levels.unionByName(top)
    last = top.where("n = 1").select(F.hex("digest")).first()
    return Manifest(leaves, nodes.drop("n"), trees, last[0].lower() if last else None)


def _levels(base: DataFrame, most: int) -> DataFrame:
    """All levels above ``base (tree, idx, digest, n)``, itself included, as ``level`` 0.

    ``n`` is the number of nodes of the tree on that level. Each level is a sixteenth of the one below
    and is written, so it is made once.
    """
    level = base.select("tree", F.lit(0).alias("level"), "idx", "digest", "n")
    found = level
    for number in range(1, 17):
        if most <= 1:
            break
        most = -(-most // ARITY)
        members = F.array_sort(F.collect_list(F.struct("idx", "digest")))
        texts = F.transform(members, lambda x: F.lower(F.hex(x["digest"])))
        parents = level.where("n > 1").groupBy("tree", F.shiftright("idx", _SHIFT).alias("idx"), "n")
        parents = parents.agg(F.unhex(F.sha2(F.concat_ws("", texts), 256)).alias("digest"))
        above = F.shiftright(F.col("n") + (ARITY - 1), _SHIFT)
        level = written(
            parents.select("tree", F.lit(number).alias("level"), "idx", "digest", above.alias("n")), "level"
        )
        found = found.unionByName(level)
    return found


def multiproof(known: np.ndarray, n: int) -> list[np.ndarray]:
    """For each level of a tree of ``n`` leaves, the nodes that ``known`` leaves need from elsewhere.

    On each level these are the members of the runs of known nodes that are not known; the runs are
    what is known of the next level.
    """
    missing = []
    known = np.unique(known)
    while n > 1:
        runs = np.unique(known >> _SHIFT)
        members = (runs[:, None] * ARITY + np.arange(ARITY)).ravel()
        missing.append(np.setdiff1d(members[members < n], known, assume_unique=True))
        known, n = runs, -(-n // ARITY)
    return missing


def _wanted(manifest: Manifest) -> DataFrame:
    """``(part, tree, level, idx)`` of the nodes that the partitions have to fetch."""
    trees = manifest.trees

    def want(group: pa.Table) -> pa.Table:
        part = group.column("part")[0].as_py()
        rows: list[tuple[int, int, np.ndarray]] = []
        for tree, n, low, high in zip(*(group.column(c).to_pylist() for c in ("tree", "n", "low", "high")), strict=True):
            rows += [(tree, k, x) for k, x in enumerate(multiproof(np.arange(low, high + 1), n))]
        own = group.column("tree").to_numpy()
        rows += [(TOP, k, x) for k, x in enumerate(multiproof(own, trees))]
        rows.append((TOP, 0, np.empty(0, np.int64)))  # there may be none
        sizes = [len(x) for *_, x in rows]
        return pa.table(
            {
                "part": pa.array(np.full(sum(sizes), part, np.int64)),
                "tree": pa.array(np.repeat(np.array([x[0] for x in rows], np.int64), sizes)),
                "level": pa.array(np.repeat(np.array([x[1] for x in rows], np.int32), sizes)),
                "idx": pa.array(np.concatenate([x for *_, x in rows]).astype(np.int64)),
            }
        )

    runs = manifest.leaves.groupBy("part", "tree", "n").agg(F.min("pos").alias("low"), F.max("pos").alias("high"))
    return runs.groupBy("part").applyInArrow(want, "part bigint, tree bigint, level int, idx bigint")


class _Tree:
    """What a partition knows of one tree: its leaves, the nodes it fetched, and what follows."""

    def __init__(self, n: int, leaves: dict[int, str], fetched: dict[int, dict[int, str]]):
        self._sizes: list[int] = []
        self._nodes: list[dict[int, str]] = []
        self._above: dict[int, dict[int, str]] = {}  # siblings of a node from its level on
        self._folded: dict[tuple[int, int, str], str] = {}
        known, derived = leaves, [leaves]
        while n > 1:
            self._sizes.append(n)
            self._nodes.append(known | fetched.get(len(self._nodes), {}))
            runs = {x >> _SHIFT for x in known}
            level = len(self._nodes) - 1
            known = {r: sha256("".join(self._run(level, r)).encode()).hexdigest() for r in runs}
            derived.append(known)
            n = -(-n // ARITY)
        (self.root,) = known.values()
        over: dict[int, str] = {}
        for level in reversed(range(1, len(self._nodes))):
            over = {
                k: "".join(self._sides(level, k)) + over.get(k >> _SHIFT, "")
                for k in derived[level]
            }
            self._above[level] = over
        # Of leaves, by far the most nodes, the siblings are put together one leaf at a time.

    def _run(self, level: int, run: int) -> list[str]:
        nodes, first = self._nodes[level], run * ARITY
        return [nodes[k] for k in range(first, min(first + ARITY, self._sizes[level]))]

    def _sides(self, level: int, node: int) -> tuple[str, str]:
        """The siblings before and after."""
        run, at = self._run(level, node >> _SHIFT), node % ARITY
        return "".join(run[:at]), "".join(run[at + 1 :])

    def proof(self, leaf: int) -> str:
        if not self._nodes:
            return ""
        over = self._above[1][leaf >> _SHIFT] if 1 in self._above else ""
        return "".join(self._sides(0, leaf)) + over

    def fold(self, leaf: int, digest: str) -> str:
        """The root that ``digest`` leads to in place of the leaf, with the siblings as they are."""
        node, passed = leaf, []
        for level in range(len(self._nodes)):
            key = level, node, digest
            known = self._folded.get(key) if level else None
            if known is not None:
                digest = known
                break
            if level:
                passed.append(key)
            before, after = self._sides(level, node)
            digest = sha256(f"{before}{digest}{after}".encode()).hexdigest()
            node >>= _SHIFT
        self._folded.update((key, digest) for key in passed)
        return digest


def proofs(manifest: Manifest) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``, a row per leaf.

    ``proof_sha256`` is the digest of all siblings from the leaf to the root, ``folded_root`` what
    the claimed leaf leads to with them, ``verified`` whether that is the root. No leaves, no rows.
    """
    root, trees = manifest.root or "", manifest.trees
    wanted = _wanted(manifest)
    fetched = written(wanted.join(manifest.nodes, ["tree", "level", "idx"]), "fetched")
    schema = (
        "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, "
        "folded_root string, verified boolean"
    )

    def expand(leaves: pa.Table, told: pa.Table) -> pa.Table:
        nodes: dict[int, dict[int, dict[int, str]]] = {}
        for tree, level, idx, digest in zip(*(told.column(c).to_pylist() for c in ("tree", "level", "idx", "digest")), strict=True):
            nodes.setdefault(tree, {}).setdefault(level, {})[idx] = digest.hex()
        columns = [leaves.column(c).to_pylist() for c in ("tree", "pos", "n", "leaf")]
        own: dict[int, tuple[int, dict[int, str]]] = {}
        for tree, pos, n, leaf in zip(*columns, strict=True):
            own.setdefault(tree, (n, {}))[1][pos] = leaf.hex()
        built = {t: _Tree(n, known, nodes.get(t, {})) for t, (n, known) in own.items()}
        top = _Tree(trees, {t: x.root for t, x in built.items()}, nodes.get(TOP, {}))
        upper = {t: top.proof(t) for t in built}
        proof, folded = [], []
        for tree, pos, claimed in zip(columns[0], columns[1], leaves.column("claimed").to_pylist(), strict=True):
            known = built[tree]
            proof.append(sha256((known.proof(pos) + upper[tree]).encode()).hexdigest())
            folded.append(top.fold(tree, known.fold(pos, claimed.hex())))
        return pa.table(
            {
                "doc_id": leaves.column("doc_id"),
                "leaf": pa.array([x.hex() for x in columns[3]]),
                "subroot": pa.array([built[t].root for t in columns[0]]),
                "root": pa.array([top.root] * len(proof), pa.string()),
                "proof_sha256": pa.array(proof, pa.string()),
                "folded_root": pa.array(folded, pa.string()),
                "verified": pa.array([x == root for x in folded], pa.bool_()),
            }
        )

    leaves = manifest.leaves.select("part", "tree", "pos", "n", "doc_id", "leaf", "claimed")
    return leaves.groupBy("part").cogroup(fetched.groupBy("part")).applyInArrow(expand, schema)


def proof_digests(docs: DataFrame) -> DataFrame:
    """The manifest of ``docs`` and the proof of each of its rows; see :func:`build`, :func:`proofs`."""
    return proofs(build(docs))


def _manifest_sql(levels: int = 5) -> str:
    """:func:`proof_digests` in DuckDB's SQL, for sources of at most 16 ** ``levels`` rows, and so many
    sources. DuckDB has no CRC-32: bytes are folded in bit by bit."""
    field = "coalesce(octet_length(encode({0}::VARCHAR)) || ':' || {0}::VARCHAR, '-')"
    fields = " || ".join(field.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
    bits = "list_concat([c::UBIGINT::HUGEINT], [-1, -1, -1, -1, -1, -1, -1, -1])"
    crc = f"""list_reduce(list_concat([4294967295::HUGEINT], flatten(list_transform(
        list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)), lambda c: {bits}))),
        lambda s, x: CASE WHEN x >= 0 THEN xor(s, x)
            ELSE xor(s // 2, (s % 2) * 3988292384) END)"""
    steps = []

    def climb(name: str, key: str) -> str:
        """Levels above ``name0 (key, idx, d, n)``; what hangs above each node is ``name_s``."""
        for k in range(levels):
            steps.append(
                f"""{name}{k + 1} AS (SELECT {key}, idx // 16 AS idx, (max(n) + 15) // 16 AS n,
                CASE WHEN max(n) = 1 THEN min(d) ELSE sha256(string_agg(d, '' ORDER BY idx)) END AS d
                FROM {name}{k} GROUP BY {key}, idx // 16)"""
            )
        return f"{name}{levels}"

    leaves = f"""WITH own AS (SELECT doc_id, source,
            sha256({fields} || {field.format('text')}) AS leaf,
            CASE WHEN xor({crc}, 4294967295) % 5 = 0
                THEN sha256({fields} || {field.format("translate(text, '" + _UPPER + "', '" + _LOWER + "')")})
            END AS claimed FROM documents),
        ranked AS (SELECT *, dense_rank() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS tree,
            row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
            count(*) OVER (PARTITION BY source) AS n FROM own),
        a0 AS (SELECT tree, pos AS idx, leaf AS d, n FROM ranked)"""
    sources = climb("a", "tree")
    steps.append(
        f"""b0 AS (SELECT 0 AS tree, tree AS idx, d, count(*) OVER () AS n FROM {sources})"""
    )
    roots = climb("b", "tree")
    # Siblings and folded digests, level by level, from the leaves up.
    steps.append(
        """w0 AS (SELECT doc_id, source, tree, pos, leaf, coalesce(claimed, leaf) AS f, '' AS s,
            pos AS idx FROM ranked)"""
    )
    last = "w0"
    for name, tree in (("a", "tree"), ("b", "0")):
        for k in range(levels):
            now = f"{last}{name}"
            steps.append(
                f"""g{now} AS (SELECT tree AS t, idx // 16 AS run, max(n) AS n,
                    list(d ORDER BY idx) AS ds FROM {name}{k} GROUP BY tree, idx // 16),
                {now} AS (SELECT doc_id, source, tree, pos, leaf, w.idx // 16 AS idx,
                    CASE WHEN n = 1 THEN f ELSE sha256(array_to_string(ds[:w.idx % 16], '') || f
                        || array_to_string(ds[w.idx % 16 + 2:], '')) END AS f,
                    CASE WHEN n = 1 THEN s ELSE s || array_to_string(ds[:w.idx % 16], '')
                        || array_to_string(ds[w.idx % 16 + 2:], '') END AS s
                    FROM {last} w JOIN g{now} g ON g.t = {'w.tree' if tree == 'tree' else '0'}
                        AND g.run = w.idx // 16)"""
            )
            last = now
        if name == "a":
            steps.append(f"x{last} AS (SELECT * REPLACE (tree AS idx) FROM {last})")
            last = f"x{last}"
    return f"""{leaves}, {', '.join(steps)}
        SELECT doc_id, leaf, a.d AS subroot, b.d AS root, sha256(s) AS proof_sha256,
            f AS folded_root, f = b.d AS verified
        FROM {last} w JOIN {sources} a ON a.tree = w.tree CROSS JOIN {roots} b"""


MANIFEST_SQL = _manifest_sql()
