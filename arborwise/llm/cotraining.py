"""Quality classifier by co-training: a text view and a metadata view teach each other.

The text view sees hashed words and the text's shape, the metadata view language, source and
length.  Both start from labelled documents; round by round each names, of all other documents,
the `most_taught` it is surest of on either side, and these are pseudo-labels for the other.  On a
held-out fold a small logistic model calibrates and combines the two views' log-odds, and it
scores every document.

Fitting starts from at most `most_labelled` labelled documents, taken by hash of doc_id.  The
pool has no bound: every round scores all documents on the executors, and each task sends ids of
its surest alone.  Scoring covers all documents and whole texts.

One model is made per label column, such as quality (1 is good) and toxic (1 is bad).  A document is rejected when
its good labels score below a half or a bad label scores above.

Defined results: null text has no words; null metadata is a value of its own; labels that
disagree count as their majority, ties as good; null labels and labels of unknown documents
are left out; where a label has one class only, or no labels exist, its score is that class
(or 0.5) and rejects nothing; of rows that repeat a doc_id the least text teaches, and each is
scored; documents with null doc_id teach nothing; an empty table gives an empty result; all
columns are kept, whatever their names, but for those called as the result's, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, _buffers, mix, slices, stash, tidy, words

BITS, META_BITS = 18, 12
MOST_LABELLED, MOST_TAUGHT, ROUNDS, SURE = 8000, 200, 3, 0.97
_SALTS = 64
META = ("lang", "source", "n_chars")


# -- features -------------------------------------------------------------------------------


_PLAIN = np.arange(256, dtype=np.uint8)  # ASCII marks part words, case is folded
_PLAIN[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 32


def text_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value) of the words, unit length per row, and a matrix of the text's shape."""
    w = words(texts, lower=True, table=_PLAIN)
    n = len(w.first) - 1
    row = np.repeat(np.arange(n), w.count())
    key, tf = np.unique((row.astype(U64) << U64(BITS)) | (w.hashes >> U64(64 - BITS)), return_counts=True)
    row, bucket = (key >> U64(BITS)).astype(np.int64), (key & U64((1 << BITS) - 1)).astype(np.int64)
    value = 1 + np.log(tf)
    length = np.sqrt(np.bincount(row, value * value, n))
    value = value / np.maximum(length[row], 1e-9)
    offsets, whole = _buffers(texts)
    b, offsets = whole[offsets[0] : offsets[-1]], offsets - offsets[0]
    total = np.maximum(np.diff(offsets), 1)

    def share(mask: np.ndarray) -> np.ndarray:
        c = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=c[1:])
        return (c[offsets[1:]] - c[offsets[:-1]]) / total

    upper, digit = (b >= 65) & (b <= 90), (b >= 48) & (b <= 57)
    mark = (b > 32) & (b < 127) & ~upper & ~digit & ~((b >= 97) & (b <= 122))
    count = np.maximum(w.count(), 1)
    most = np.zeros(n)
    np.maximum.at(most, row, tf)
    twice = np.zeros(len(w.hashes) + 1)
    twice[2:] = np.cumsum(w.hashes[1:] == w.hashes[:-1])
    twice = (twice[np.maximum(w.first[1:], 1)] - twice[np.minimum(w.first[:-1] + 1, len(w.hashes))]) * (w.count() > 1)
    sparse = (w.count() < 12).astype(float)
    shape = [twice / count * 4, sparse, np.log1p(w.count()) / 8, share(upper) * 4, share(digit) * 8, share(mark) * 4, total / count / 10, np.bincount(row, minlength=n) / count, most / count * 4, share(b == 10) * 20]
    return row, bucket, value, np.stack(shape, 1)


def meta_features(batch: pa.RecordBatch, columns: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value): one bucket per column's value; numbers by their logarithm's floor; and one per pair."""
    n, seen = batch.num_rows, []
    for c in columns:
        v = batch.column(c)
        if pa.types.is_integer(v.type) or pa.types.is_floating(v.type):
            x = v.cast(pa.float64()).fill_null(-1.0).to_numpy(zero_copy_only=False)
            text = [f"{c}={int(np.log2(k + 1) * 2) if k >= 0 else 'null'}" for k in np.nan_to_num(x, nan=-1.0, posinf=1e300)]
        else:
            text = [f"{c}={'null' if k is None else 'is ' + k}" for k in v.cast(pa.string()).to_pylist()]
        seen.append(words(pa.array([t.replace(" ", "_") for t in text], pa.string())).hashes)
    seen += [mix(seen[i] * U64(3) + seen[j]) for i in range(len(columns)) for j in range(i)]
    if not seen:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    bucket = np.concatenate([(h >> U64(64 - META_BITS)).astype(np.int64) for h in seen])
    return np.tile(np.arange(n), len(seen)), bucket, np.full(len(bucket), 1 / len(seen))


class View:
    """Logistic regression over (row, bucket, value) triples and a few dense columns, all labels of one view."""

    def __init__(self, buckets: int, dense: int):
        self.w, self.d, self.bias = np.zeros(buckets), np.zeros(dense), 0.0

    def logits(self, n: int, row, bucket, value, dense) -> np.ndarray:
        return np.bincount(row, value * self.w[bucket], n) + dense @ self.d + self.bias

    def fit(self, n: int, row, bucket, value, dense, y: np.ndarray, weight: np.ndarray, steps: int = 60, ridge: float = 1e-5) -> View:
        use, place, df = np.unique(bucket, return_inverse=True, return_counts=True)
        value = np.where(df[place] >= 4, value, 0.0)  # words of fewer rows teach nothing
        w, d, bias = np.zeros(len(use)), np.zeros(dense.shape[1]), 0.0
        m, v = np.zeros(len(use) + len(d) + 1), np.zeros(len(use) + len(d) + 1)
        weight = weight / weight.sum()
        for t in range(1, steps + 1):
            z = np.bincount(row, value * w[place], n) + dense @ d + bias
            g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
            grad = np.r_[np.bincount(place, value * g[row], len(use)) + ridge * w, dense.T @ g + 1e-5 * d, g.sum()]
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
            move = 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9) * (1 - 0.9 * t / steps)
            w, d, bias = w - move[: len(use)], d - move[len(use) : -1], bias - move[-1]
        self.w[:], self.d, self.bias = 0, d, float(bias)
        self.w[use] = w
        return self


def _rows(n: int, keep: np.ndarray, row, bucket, value, dense):
    """The features of some rows, numbered anew."""
    place = np.full(n, -1)
    place[keep] = np.arange(len(keep))
    on = place[row] >= 0
    return len(keep), place[row[on]], bucket[on], value[on], dense[keep]


def fitted(features: tuple, n: int, known: list[dict[int, int]], real: int) -> list[View]:
    """Both views from what each knows: row -> label; rows from `real` on are pseudo-labelled and weigh half."""
    views = [View(1 << BITS, features[0][3].shape[1]), View(1 << META_BITS, 0)]
    for view, f, said in zip(views, features, known, strict=True):
        at = np.array(sorted(said))
        view.fit(*_rows(n, at, *f), np.array([said[i] for i in at.tolist()], float), np.where(at < real, 1.0, 0.5))
    return views


def combined(views: list[View], features: tuple, n: int, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """Weights (bias, text, metadata) of the views' log-odds, fitted on the held-out fold."""
    if len(fold) < 20 or len(set(y[fold].tolist())) < 2:
        return np.array([0.0, 1.0, 0.0])
    z = np.stack([np.ones(len(fold)), *(np.clip(v.logits(n, *f)[fold], -20, 20) for v, f in zip(views, features, strict=True))], 1)
    c, ridge = np.array([0.0, 0.7, 0.1]), np.diag([0.1, 0.1, 0.1])
    for _ in range(30):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(z @ c, -30, 30)))
        c = c - np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (p - y[fold]) + ridge @ (c - [0.0, 0.7, 0.1]))
    return c


# -- over the cluster -----------------------------------------------------------------------


def _featured(columns: list[str], kept: list[str]):
    """The features of each document, packed; made on the executors, so that no text goes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(batch.column("text")):
                part = batch.slice(i, j - i)
                n = part.num_rows
                row, bucket, value, dense = text_features(part.column("text"))
                cut = np.r_[0, np.cumsum(np.bincount(row, minlength=n))]
                _, mbucket, _ = meta_features(part, columns)
                packed = {
                    "bucket": [bucket[a:z].astype(np.int32).tobytes() for a, z in zip(cut, cut[1:], strict=False)],
                    "value": [value[a:z].astype(np.float32).tobytes() for a, z in zip(cut, cut[1:], strict=False)],
                    "dense": [dense[k].tobytes() for k in range(n)],
                    "meta": [mbucket[k::n].astype(np.int32).tobytes() for k in range(n)],
                }
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *(pa.array(v, pa.binary()) for v in packed.values())], [*kept, *packed])

    return run


def _collected(rows: DataFrame, columns: list[str], kept: list[str], least: int):
    """Features of a bounded number of documents, in the order of doc_id; words of fewer than `least` of them are left out."""
    kinds = ", ".join(f"{c} {'long' if c == 'doc_id' else 'int'}" for c in kept)
    made = rows.mapInArrow(_featured(columns, kept), f"{kinds}, bucket binary, value binary, dense binary, meta binary")
    table = made.orderBy("doc_id").toArrow()
    n = table.num_rows
    join = lambda c, kind: np.frombuffer(b"".join(table.column(c).to_pylist()), kind)
    lens = lambda c: np.array([len(x) // 4 for x in table.column(c).to_pylist()], np.int64)
    row, bucket, value = np.repeat(np.arange(n, dtype=np.int32), lens("bucket")), join("bucket", np.int32), join("value", np.float32)
    known = np.bincount(bucket, minlength=1 << BITS)[bucket] >= least
    text = (row[known], bucket[known], value[known], join("dense", np.float64).reshape(n, -1))
    each = lens("meta")
    meta = (np.repeat(np.arange(n), each), join("meta", np.int32), np.repeat(1 / np.maximum(each, 1), each), np.zeros((n, 0)))
    return table.select(kept), n, text, meta


def _appended(old: tuple, new: tuple, n: int) -> tuple:
    """The features of more rows after the first n."""
    if not n:
        return new
    row, *rest = new
    return tuple(np.concatenate(x) for x in zip(old, (row + row.dtype.type(n), *rest), strict=True))


def _given(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *columns)


def _chosen(docs: DataFrame, columns: list[str], rows: list[tuple], schema: str) -> DataFrame:
    """The documents of some ids (a bounded number), one row each: of rows that repeat an id the least text."""
    few = docs.sparkSession.createDataFrame(rows, schema)
    kept = [c for c in few.columns if c != "doc_id"]
    full = _given(docs, columns).join(F.broadcast(few), "doc_id")
    return full.groupBy("doc_id", *kept).agg(F.min(F.struct("text", *columns)).alias("s")).select("doc_id", *kept, "s.*")


def _logits(slim: tuple, n: int, text: tuple, meta: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of both views, within what exp can take."""
    (row, bucket, value, dense), (mrow, mbucket, mvalue) = text, meta
    w, d, bias, mw, mbias, _ = slim
    return np.clip(np.bincount(row, value * w[bucket], n) + dense @ d + bias, -20, 20), np.clip(np.bincount(mrow, mvalue * mw[mbucket], n) + mbias, -20, 20)


def _slim(views: list[View], c: np.ndarray | None = None) -> tuple:
    return views[0].w.astype(np.float32), views[0].d, views[0].bias, views[1].w.astype(np.float32), views[1].bias, c


def surest(z: np.ndarray, ids: np.ndarray, most: int, sure: float) -> list[np.ndarray]:
    """Rows of the `most` lowest and highest log-odds beyond the threshold, ties by hash of the id."""
    least, tie = np.log(sure / (1 - sure)), mix(ids.view(U64))
    return [order[z[order] * sign > least][:most] for sign in (-1, 1) for order in [np.lexsort((tie, -sign * z))[: 4 * most]]]


def _taught(models: dict, columns: list[str], taken, most: int, sure: float):
    """Of each task's documents, those that each view of each head is surest of: doc_id, head, view, side and log-odds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, best = taken.value, {}
        for batch in batches:
            for i, j in slices(batch.column("text")):
                part = batch.slice(i, j - i)
                ids = part.column("doc_id").to_numpy()
                free = np.flatnonzero(~np.isin(ids, known))
                text, meta = text_features(part.column("text")), meta_features(part, columns)
                for h, slim in models.items():
                    for view, z in enumerate(_logits(slim, part.num_rows, text, meta)):
                        old_ids, old_z = best.get((h, view), (ids[:0], z[:0]))
                        all_ids, all_z = np.r_[old_ids, ids[free]], np.r_[old_z, z[free]]
                        at = np.unique(np.concatenate(surest(all_z, all_ids, most, sure)))
                        best[h, view] = all_ids[at], all_z[at]
        for (h, view), (ids, z) in best.items():
            if len(ids):
                same = lambda v, kind: pa.array([v] * len(ids), kind)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(ids), same(h, pa.string()), same(view, pa.int32()), pa.array((z > 0).astype(np.int32)), pa.array(z)], ["doc_id", "head", "view", "side", "z"])
        tidy()

    return run


def exchange(docs: DataFrame, models: dict, columns: list[str], taken: np.ndarray, most: int = MOST_TAUGHT, sure: float = SURE) -> list:
    """Of all documents but those taken, the `most` that each view of each head is surest of on either side."""
    given = docs.sparkSession.sparkContext.broadcast(taken)
    found = stash(_given(docs, columns).mapInArrow(_taught(models, columns, given, most, sure), "doc_id long, head string, view int, side int, z double"))
    found = found.groupBy("doc_id", "head", "view", "side").agg(F.max(F.abs("z")).alias("z")).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(_SALTS)))
    for keys in (["head", "view", "side", "salt"], ["head", "view", "side"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("z").desc(), F.xxhash64("doc_id"), "doc_id"))
        found = found.withColumn("rank", rank).where(F.col("rank") <= most).drop("rank")
    return sorted(found.select("doc_id", "head", "view", "side").collect())  # `most` a side, view and head


def fit(docs: DataFrame, labels: DataFrame, good: tuple[str, ...], bad: tuple[str, ...], columns: list[str], most_labelled: int, most_taught: int, rounds: int = ROUNDS, sure: float = SURE) -> dict:
    """A model per label column: (text weights, shape weights, bias, metadata weights, bias, combining weights) or a constant."""
    heads = [*good, *bad]
    votes = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        *(F.when(F.avg(h) != 0.5, (F.avg(h) > 0.5).cast("int")).otherwise(F.when(F.avg(h) == 0.5, F.lit(int(h in good)))).alias(f"_{h}") for h in heads)
    )
    ids = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    some = ids.join(votes, "doc_id").withColumn("_h", F.xxhash64("doc_id")).orderBy("_h", "doc_id").limit(most_labelled).drop("_h").collect()
    if not some:
        return {h: 0.5 for h in heads}
    kinds = "doc_id long, " + ", ".join(f"_{h} int" for h in heads)
    table, n, text, meta = _collected(_chosen(docs, columns, [tuple(r) for r in some], kinds), columns, ["doc_id", *(f"_{h}" for h in heads)], 4)
    tidy()
    place = {d: i for i, d in enumerate(table.column("doc_id").to_pylist())}
    held, real = mix(table.column("doc_id").to_numpy().view(U64)) % U64(5) == 0, n
    out, y, known = {}, {}, {}
    for h in heads:
        y[h] = np.array([-1 if v is None else v for v in table.column(f"_{h}").to_pylist()])
        base = np.flatnonzero((y[h] >= 0) & ~held)
        seen = np.unique(y[h][base])
        if len(seen) < 2:
            out[h] = float(seen[0]) if len(seen) else 0.5
        else:
            known[h] = [dict(zip(base.tolist(), y[h][base].tolist(), strict=True)) for _ in range(2)]
    for k in range(rounds + 1):
        views = {h: fitted((text, meta), n, said, real) for h, said in known.items()}
        if k == rounds or not known:
            break
        told = exchange(docs, {h: _slim(v) for h, v in views.items()}, columns, np.array(sorted(place), np.int64), most_taught, sure)
        new = sorted({r.doc_id for r in told})
        if not new:
            break
        more, m, text_, meta_ = _collected(_chosen(docs, columns, [(d,) for d in new], "doc_id long"), columns, ["doc_id"], 1)
        place |= {d: n + i for i, d in enumerate(more.column("doc_id").to_pylist())}
        text, meta, n = _appended(text, text_, n), _appended(meta, meta_, n), n + m
        for r in told:
            known[r.head][1 - r.view][place[r.doc_id]] = r.side
        del more, text_, meta_
        tidy()
    for h in known:
        out[h] = _slim(views[h], combined(views[h], (text, meta), n, np.r_[y[h], np.full(n - real, -1)], np.flatnonzero(held & (y[h] >= 0))))
    del text, meta
    tidy()
    return {h: out[h] for h in heads}


def _score(models: dict, columns: list[str], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(batch.column("text")):
                part = batch.slice(i, j - i)
                n = part.num_rows
                text, meta = text_features(part.column("text")), meta_features(part, columns)
                made = {}
                for h, m in models.items():
                    if isinstance(m, float):
                        made[f"{h}_score"] = made[f"{h}_text"] = made[f"{h}_meta"] = np.full(n, m)
                        continue
                    zt, zm = _logits(m, n, text, meta)
                    for k, z in (("score", m[5][0] + m[5][1] * zt + m[5][2] * zm), ("text", zt), ("meta", zm)):
                        made[f"{h}_{k}"] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                yield pa.RecordBatch.from_arrays([pa.array(made[f.name]) if f.name in made else part.column(f.name).cast(f.type) for f in schema], schema=schema)

    return run


def quality(docs: DataFrame, labels: DataFrame, good: tuple[str, ...] = ("quality",), bad: tuple[str, ...] = ("toxic",), meta: tuple[str, ...] = META, most_labelled: int = MOST_LABELLED, most_taught: int = MOST_TAUGHT) -> DataFrame:
    """docs with {label}_score, {label}_text and {label}_meta for each label, and rejected."""
    from pyspark.sql.pandas.types import to_arrow_schema

    columns = [c for c in meta if c in docs.columns]
    heads = [*good, *bad]
    names = [f"{h}_{k}" for h in heads for k in ("score", "text", "meta")]
    base = docs.drop(*names, "rejected")
    models = fit(base, labels, good, bad, columns, most_labelled, most_taught)
    base = base.withColumn("text", F.col("text").cast("string"))
    schema = T.StructType([*base.schema.fields, *(T.StructField(c, T.DoubleType()) for c in names)])
    scored = base.mapInArrow(_score(models, columns, to_arrow_schema(schema)), schema)
    rejected = F.lit(False)
    for h in good:
        rejected |= F.col(f"{h}_score") < 0.5
    for h in bad:
        rejected |= F.col(f"{h}_score") > 0.5
    return scored.withColumn("rejected", rejected)


def digest(spark, sf_dir: str) -> DataFrame:
    """Scores and verdict of every document."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality(docs, labels)
    return scored.select("doc_id", *(c for c in scored.columns if c.endswith(("_score", "_text", "_meta"))), "rejected")
