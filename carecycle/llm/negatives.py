"""Hard negatives found with Fagin's threshold algorithm."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carecycle.llm.storage import written

SCALE = 256  # components become floor(SCALE * x)
POSITIVES = 5  # of each anchor
NEGATIVES = 5  # of each positive
LEAST = 80  # per cent of the positive's score that a negative must reach
SHARD_ROWS = 8192  # candidates whose lists are sorted together
ANCHOR_ROWS = 1024  # anchors that meet a shard together
STEP = 32  # entries read from each list in the first round; each round doubles what is read

_EXACT = 1 << 53  # below it, sums of products are exact in double precision
_MOST = (1 << 63) - 1


@dataclass
class Lists:
    """The candidates of one shard: their integer vectors, and one list for each dimension, in ascending order."""

    vectors: np.ndarray
    order: np.ndarray = field(init=False)
    values: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.order = np.argsort(self.vectors, axis=0, kind="stable")
        self.values = np.take_along_axis(self.vectors, self.order, 0)

    def top(
        self, anchor: np.ndarray, windows: list[tuple[int, int]], k: int, wanted: np.ndarray
    ) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window (low, high) of scores, candidates that include its k highest, and their scores.

        Sorted access reads every list from the end where its products with
        the anchor are greatest; a dimension in which the anchor is 0 is not
        read. Each candidate met is scored at once from its whole vector. The
        products of the entries read last sum to the threshold, which no
        candidate unmet can exceed. Reading stops once the threshold is
        strictly below every window's k-th score, or below its low end where
        fewer are met, or once every candidate is met; ties at the k-th score
        are all met by then.
        """
        n = len(self.vectors)
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        met = np.zeros(n, bool)
        rows, scores = np.zeros(0, np.int64), np.zeros(0, self.vectors.dtype)
        at = 0
        while at < n:
            to = min(n, max(STEP, 2 * at))
            if len(up) + len(down):
                reached = [self.order[n - to : n - at, up].ravel(), self.order[at:to, down].ravel()]
                new = np.zeros(n, bool)
                new[np.concatenate(reached)] = True
                new &= ~met
            else:  # every score is 0 and no list tells candidates apart
                to, new = n, ~met
            met |= new
            everything = met.all()
            new = np.flatnonzero(new & wanted)
            score = self.vectors[new] @ anchor
            score = score if score.dtype != object else np.clip(score, -_MOST, _MOST)
            rows, scores = np.concatenate([rows, new]), np.concatenate([scores, score])
            at = n if everything else to
            if at < n:
                threshold = (anchor[up] * self.values[n - at, up]).sum() + (anchor[down] * self.values[at - 1, down]).sum()
                if all(self._closed(scores, threshold, low, high, k) for low, high in windows):
                    break
        inside = [(scores >= low) & (scores <= high) for low, high in windows]
        return [(rows[x], scores[x]) for x in inside]

    @staticmethod
    def _closed(scores: np.ndarray, threshold, low: int, high: int, k: int) -> bool:
        if threshold < low:
            return True
        inside = scores[(scores >= low) & (scores <= high)]
        return len(inside) >= k and threshold < np.partition(inside, len(inside) - k)[len(inside) - k]


def _matrix(vectors: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), "<f8").reshape(len(vectors), -1)


def _exact(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two in a type in which their inner products are exact: double, or integers of any size."""
    if a.size == 0 or float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < _EXACT:
        return a, b
    whole = np.vectorize(int, otypes=[object])
    return whole(a), whole(b)


class _Named:
    """Row numbers and ids of a shard's candidates; ``none`` says where an id is null."""

    def __init__(self, rows: pd.DataFrame):
        self.row, self.id, self.none = (rows[c].to_numpy() for c in ("row", "id", "none"))

    def first(self, found: np.ndarray, scores: np.ndarray, k: int) -> list[tuple[int, int | None, int]]:
        """(row, id, score) of the k first of ``found``: by descending score, then by id, null last, then by row."""
        scores = scores.astype(np.int64)
        if len(found) > k:
            high = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
            found, scores = found[high], scores[high]
        order = np.lexsort((self.row[found], self.id[found], self.none[found], -scores))[:k]
        return [
            (int(self.row[i]), None if self.none[i] else int(self.id[i]), int(s))
            for i, s in zip(found[order], scores[order])
        ]


def _positives(k: int):
    def of(key: tuple, asking: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        for label, anchors in asking.groupby("label"):
            rows = asked[asked["label"] == label].reset_index(drop=True)
            if rows.empty:
                continue
            a, x = _exact(_matrix(list(anchors["vec"])), _matrix(list(rows["vec"])))
            lists, named = Lists(x), _Named(rows)
            for anchor, mine in zip(a, anchors["row"]):
                found, scores = lists.top(anchor, [(-np.inf, np.inf)], k, named.row != mine)[0]
                out += [(mine, *r) for r in named.first(found, scores, k)]
        return _frame(out, ["anchor", "row", "positive_id", "positive_score"])

    return of


def _negatives(k: int, least: int):
    def of(key: tuple, asking: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asking) and len(asked):
            a, x = _exact(_matrix(list(asking["vec"])), _matrix(list(asked["vec"])))
            lists, named, labels = Lists(x), _Named(asked), asked["label"].to_numpy()
            for anchor, r in zip(a, asking.itertuples()):
                windows = [(-(-least * int(p) // 100), int(p)) for p in r.scores]
                places = [j for j, (low, high) in enumerate(windows) if low <= high]
                met = lists.top(anchor, [windows[j] for j in places], k, labels != r.label)
                for j, (found, scores) in zip(places, met):
                    out += [(r.row, j, *n) for n in named.first(found, scores, k)]
        return _frame(out, ["anchor", "place", "row", "negative_id", "negative_score"])

    return of


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names).astype("Int64")


def _scaled(scale: int):
    """The bytes of floor(scale * x) in double precision, for vectors without a null or a component that is not finite."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, found = [], []
            for i, v in enumerate(batch.column(2).to_pylist()):
                if v is not None and None not in v:
                    with np.errstate(over="ignore", invalid="ignore"):
                        x = np.floor(np.array(v, "<f8") * scale)
                    if np.isfinite(x).all():
                        keep.append(i)
                        found.append(x.tobytes())
            columns = [batch.column(k).take(pa.array(keep, pa.int64())) for k in (0, 1, 3)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.binary())], ["vec_id", "label", "asks", "vec"])

    return rows


def mine(
    vectors: DataFrame, anchors: Column, id_col: str = "vec_id", label_col: str = "label",
    vector_col: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST,
    shard_rows: int = SHARD_ROWS, anchor_rows: int = ANCHOR_ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): negatives hard for their anchor.

    ``anchors`` says which rows ask. Components become floor(SCALE * x); the
    score of two rows is the integer inner product of theirs. A row ranks by
    descending score, then by ascending id (null last). An anchor's positives
    are its first ``positives`` other rows of the same label. For each, the
    first ``negatives`` rows of another label are returned whose score is at
    least ``least`` per cent of the positive's and at most the positive's; a
    positive without such rows is not returned, and so is one of negative
    score, as no score lies in that range.

    Rows with a null label or vector, or a component that is null, not finite
    or beyond 1/SCALE of the greatest double, take no part; vectors of other
    lengths are no candidates. Rows that repeat are rows of their own, so the
    copy of an anchor can be its positive. Scores beyond 64 bits count as the
    greatest of 64 bits. Other columns are ignored; an empty table, or one
    without an anchor, gives no rows.

    Every anchor asks all rows, in blocks: candidates are dealt into shards of
    about ``shard_rows`` by row, so no label or vector makes one larger, and
    ``anchor_rows`` anchors meet a shard at a time. In each meeting the
    threshold algorithm (``Lists.top``) reads the shard's sorted lists; the
    shards' first rows of each anchor, or of each positive, are merged.
    """
    spark = vectors.sparkSession
    source = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"),
        F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(anchors, F.lit(False)).alias("asks"),
    )
    rows = source.filter("label IS NOT NULL").mapInArrow(_scaled(SCALE), "vec_id long, label string, asks boolean, vec binary")
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()).withColumn("size", F.length("vec")), "vectors")
    n, asking = rows.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-asking // anchor_rows))
    shard, block = F.pmod(F.xxhash64("row"), F.lit(shards)), F.pmod(F.xxhash64("row", F.lit(0)), F.lit(blocks))
    meeting = ["size", "block", "shard"]
    each_block = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block")
    each_shard = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard")
    own = [F.col(c).alias(c) for c in ("size", "row", "label", "vec")]  # columns apart from the anchors'
    own += [F.coalesce("vec_id", F.lit(0)).alias("id"), F.col("vec_id").isNull().alias("none")]
    asked = rows.select(*own, each_block, shard.alias("shard")).groupBy(*meeting)
    asks = rows.filter("asks").select("size", block.alias("block"), "row", "label", "vec")

    best = asks.select("*", each_shard).groupBy(*meeting).cogroup(asked).applyInPandas(
        _positives(positives), "anchor long, row long, positive_id long, positive_score long"
    )
    best = _ranked(best, ["anchor"], "positive_score", "positive_id", positives).withColumn("place", F.col("rank") - 1)
    best = written(best.select("anchor", "place", "positive_id", "positive_score"), "positives")

    wanted = best.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "positive_score"))).alias("p"))
    wanted = wanted.select(F.col("anchor").alias("row"), F.col("p.positive_score").alias("scores"))
    again = asks.join(wanted, "row").select("*", each_shard)
    found = again.groupBy(*meeting).cogroup(asked).applyInPandas(
        _negatives(negatives, least), "anchor long, place long, row long, negative_id long, negative_score long"
    )
    found = _ranked(found, ["anchor", "place"], "negative_score", "negative_id", negatives)
    named = rows.filter("asks").select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return found.join(best, ["anchor", "place"]).join(named, "anchor").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


def _ranked(found: DataFrame, by: list[str], score: str, name: str, k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc(score), F.asc_nulls_last(name), "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


SQL = """
WITH vectors AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, a.label AS anchor_label, r.vec_id, r.label,
           CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
    FROM vectors a JOIN vectors r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id
), positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score
    FROM scored WHERE label = anchor_label
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s USING (anchor_id)
WHERE s.label <> s.anchor_label AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
QUALIFY rank <= 5
"""
