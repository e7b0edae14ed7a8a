"""SimHash near-duplicates: fingerprints of word shingles, linked at a few differing bits.

With ``segments = max_bits // 2 + 1`` segments, two fingerprints within ``max_bits`` differ in at
most one bit of some segment. So every segment is indexed as it is and once for each bit left out
(a deletion variant), and equal keys are verified on the whole fingerprint. Only distinct
fingerprints are indexed; copies are one fingerprint however many there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.chunks import slices
from millrace.llm.components import components
from millrace.plans.staging import stage

BITS = 64
SEED = 42
# Fingerprints that share one exact segment value beyond this number are linked by wildcards alone.
CROWD = 256


def fingerprint(text: str, shingle_words: int) -> int:
    """Signed 64-bit fingerprint of one text; 0 for a text without words."""
    words = text.encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - shingle_words + 1)
    starts = np.concatenate([[0], ends[: n - 1] + 1])
    digest = xxhash.xxh64_intdigest
    hashes = [digest(line[a:b], SEED) for a, b in zip(starts.tolist(), ends[-n:].tolist())]
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    most = np.packbits(bits.sum(0, dtype=np.int64) * 2 > n, bitorder="little")
    return int(most.view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle_words: int = 3) -> DataFrame:
    """``doc_id, fp`` of each row: bit ``b`` is set if it is in over half the shingles' XXH64.

    A-Z are lower-cased, words lie between ASCII white space, repeated shingles count again, fewer
    words than a shingle are one shingle. Null and wordless texts have fingerprint 0.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in slices(batches):
            values = [fingerprint(t, shingle_words) for t in table["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([table["doc_id"].combine_chunks().cast(table.schema.field("doc_id").type), pa.array(values, pa.int64())], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(hashed, f"doc_id {dict(rows.dtypes)['doc_id']}, fp long")


def _signed(value: int) -> int:
    value &= (1 << BITS) - 1
    return value - (1 << BITS) if value >> (BITS - 1) else value


def _segments(max_bits: int) -> list[tuple[int, int]]:
    """First bit and width of each segment."""
    n = max_bits // 2 + 1
    edges = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _segment(fp: Column, first: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << width) - 1)) if width < BITS else fp


def _keys(segment: int, first: int, width: int, side: int) -> Column:
    """Index keys of a segment: the value itself, and the value without each bit that equals ``side``.

    The value's two partners lie on different sides, so a pair meets under one key only.
    """
    value = _segment(F.col("fp"), first, width)
    variants = [
        F.when(
            F.getbit(F.col("fp"), F.lit(first + bit)) == side,
            F.struct(F.lit(segment * (BITS + 1) + bit + 1).alias("variant"), value.bitwiseAND(F.lit(_signed(~(1 << bit)))).alias("key")),
        )
        for bit in range(width)
    ]
    exact = F.struct(F.lit(segment * (BITS + 1)).alias("variant"), value.alias("key"))
    return F.array_compact(F.array(exact, *variants))


def links(prints: DataFrame, max_bits: int = 2, crowd: int = CROWD) -> DataFrame:
    """Pairs ``a, b`` that connect all distinct fingerprints ``fp`` of a staged table within
    ``max_bits`` bits: every such pair itself, but within crowds links through a common partner.

    Where more than ``crowd`` fingerprints share a segment, pairs inside the crowd would grow with
    its square. Those fingerprints are linked exactly by variants of the whole fingerprint instead:
    one for each choice of ``max_bits`` bits left out, each shared by at most ``2 ** max_bits``.
    """
    segments = _segments(max_bits)
    counted = None
    for number, (first, width) in enumerate(segments):
        rows = prints.select("fp", F.lit(number).alias("segment"), _segment(F.col("fp"), first, width).alias("value"))
        counted = rows if counted is None else counted.union(rows)
    crowds = counted.groupBy("segment", "value").agg(F.count("*").alias("n")).filter(F.col("n") > crowd)
    # Fingerprints of a crowd, by segment; a crowd of n costs n rows here.
    crowded = stage(counted.join(crowds, ["segment", "value"], "left_semi").groupBy("fp").agg(F.collect_set("segment").alias("crowds")), "simhash-crowds")
    any_crowd = crowded.limit(1).count() > 0
    marked = prints.join(crowded, "fp", "left") if any_crowd else prints.withColumn("crowds", F.lit(None).cast("array<int>"))
    marked = marked.select("fp", F.coalesce("crowds", F.array().cast("array<int>")).alias("crowds"))

    def side(bit: int) -> DataFrame:
        keys = F.flatten(F.array(*[_keys(i, first, width, bit) for i, (first, width) in enumerate(segments)]))
        rows = marked.select("fp", "crowds", F.explode(keys).alias("k"))
        name = "ab"[bit]
        return rows.select(F.col("k.variant").alias("variant"), F.col("k.key").alias("key"), F.col("fp").alias(name), F.array_contains("crowds", F.expr(f"k.variant div {BITS + 1}").cast("int")).alias(f"in_crowd_{name}"))

    exact = F.col("variant") % (BITS + 1) == 0
    pairs = (
        # Exploded sides are larger than the planner thinks; neither may be broadcast.
        side(0).hint("merge").join(side(1).hint("merge"), ["variant", "key"])
        .filter((~exact | (F.col("a") < F.col("b"))) & ~(F.col("in_crowd_a") & F.col("in_crowd_b")))
        .filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
        .select("a", "b")
    )
    if not any_crowd:
        return pairs
    masks = F.array(*[F.lit(_signed(~sum(1 << b for b in chosen))) for chosen in combinations(range(BITS), max_bits)])
    variants = crowded.select("fp", F.posexplode(masks).alias("variant", "mask")).select("fp", "variant", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    shared = variants.groupBy("variant", "key").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)
    within = shared.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a != b")
    return pairs.union(within)


def near_duplicates(docs: DataFrame, id_col: str, text_col: str, shingle_words: int = 3, max_bits: int = 2, crowd: int = CROWD) -> DataFrame:
    """``doc_id, fp, fingerprint, component_id`` for each row.

    Fingerprints within ``max_bits`` bits are linked, also those of wordless texts (0); the
    component is the smallest id reachable. Equal rows stay rows of their own. Null ids are never
    the smallest; a component of null ids alone has a null ``component_id``. An empty table gives
    no rows; other columns are ignored.
    """
    prints = stage(fingerprints(docs, id_col, text_col, shingle_words), "simhash-prints")
    distinct = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    members = stage(components(links(distinct.select("fp"), max_bits, crowd), "a", "b"), "simhash-members")
    # The smallest fingerprint names a component until its smallest id is known.
    placed = distinct.join(members.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    smallest = placed.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = placed.join(smallest, "component").select("fp", "component_id")
    # Only the fingerprint of a large group of copies is frequent; Spark splits its rows.
    return prints.join(named, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, id_col: str, text_col: str, shingle_words: int = 3, max_bits: int = 2) -> DataFrame:
    """One row of each component, with all its columns: the one of smallest id, then of smallest text hash.

    Rows are told apart by id and text, so equal ids of different texts do no harm, and of wholly
    equal rows one stays.
    """
    keyed = docs.withColumn("_row", F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tie")))
    found = near_duplicates(keyed, "_row", text_col, shingle_words, max_bits)
    first = found.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("_row"))
    return keyed.join(first, "_row", "left_semi").dropDuplicates(["_row"]).drop("_row")
