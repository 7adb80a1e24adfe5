"""Logistic regressions of many labels, strengths and folds at once: every pass over the rows gives the gradients of
all of them, a dense block of a few rows and the features they hold times a matrix of weights."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivenry.operators.ranks import drawn
from scrivenry.sources.batches import parts, small_batches
from scrivenry.sources.scratch import stored

#: Weights of the models that are fitted together (a bound on what a worker and the driver hold), features whose
#: gradients travel together, weights that a block of rows takes at once, and cells of a block of more than a row.
WEIGHTS, FEATURES, PRODUCTS, CELLS = 1 << 24, 1 << 12, 1 << 22, 1 << 20


def label_folds(df: DataFrame, labels: str, key: str, k: int, seed: int) -> DataFrame:
    """(key, folds): for each label of an array an own fold, equal shares of each class by drawn order."""
    each = df.select(key, F.posexplode(labels).alias("__tag", "__y"))
    dealt = drawn(each, ["__tag", "__y"], seed, key, "__r")
    own = dealt.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("__tag", ((F.col("__r") - 1) % k).cast("int").alias("f")))).alias("__f"))
    return own.select(key, F.transform("__f", lambda x: x["f"]).alias("folds"))


def sparse(df: DataFrame, column: str) -> DataFrame:
    """``df`` with a column of vectors, or of arrays of numbers, as structs of indices and values."""
    from pyspark.ml.linalg import VectorUDT
    from pyspark.sql.types import ArrayType, StructField, StructType

    kind = StructType.fromDDL("indices array<int>, values array<float>")
    if isinstance(df.schema[column].dataType, ArrayType):
        values = F.coalesce(F.col(column).cast("array<float>"), F.array().cast("array<float>"))
        made = F.struct(F.transform(values, lambda v, i: i).alias("indices"), values.alias("values"))
        return df.withColumn(column, made)
    if not isinstance(df.schema[column].dataType, VectorUDT):
        return df.withColumn(column, F.col(column).cast(kind))
    place = df.columns.index(column)
    small_batches(df.sparkSession)

    def split(batches):
        import pyarrow as pa

        for b in parts(batches):
            own = b.column(place)
            if own.null_count == 0 and own.field("indices").null_count == 0 and own.field("values").null_count == 0:
                at, values = own.field("indices"), own.field("values").cast(pa.list_(pa.float32()))
            else:  # some are dense, or null
                at, values = [], []
                for v in own.to_pylist():
                    dense = np.asarray(v["values"] if v else [], np.float32)
                    at.append(np.arange(len(dense), dtype=np.int32) if not v or v["indices"] is None else v["indices"])
                    values.append(dense)
                at, values = pa.array(at, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))
            made = pa.StructArray.from_arrays([at.cast(pa.list_(pa.int32())), values], names=["indices", "values"])
            yield pa.RecordBatch.from_arrays([made if i == place else c for i, c in enumerate(b.columns)], names=b.schema.names)

    return df.mapInArrow(split, StructType([StructField(f.name, kind if f.name == column else f.dataType) for f in df.schema.fields]))


def matrix_rows(df: DataFrame, labels: str, features: str, key: str, k: int, seed: int) -> DataFrame:
    """key, at, value, labels, folds of rows with unique keys, stored: many passes read them.  features is a sparse
    vector; labels an array with 1 for what has the label."""
    small_batches(df.sparkSession)
    df = sparse(df.select(key, labels, features), features)
    df = df.select(key, labels, F.col(f"{features}.indices").alias("at"), F.col(f"{features}.values").alias("value"))
    # Stored before the folds are drawn, which reads the keys and labels more than once: features are made once.
    df = stored(df.withColumn("labels", F.transform(labels, lambda y: F.coalesce(y.cast("double"), F.lit(0.0)))), "made")
    return stored(df.join(label_folds(df, "labels", key, k, seed), key).select(key, "at", "value", "labels", "folds"), "rows")


def _blocks(batch, size: int) -> Iterator[tuple]:
    """(rows, own, x, labels, folds) of a few rows each; own: the features, of ``size`` in all, that any of them has,
    x: their values, a dense row for each row."""
    if not batch.num_rows:
        return
    names = batch.schema.names
    at, value, labels, folds = (batch.column(names.index(n)) for n in ("at", "value", "labels", "folds"))
    lengths = at.value_lengths().fill_null(0).to_numpy()
    ends = np.append(0, np.cumsum(lengths, dtype=np.int64))
    y = np.array(labels.to_pylist(), np.float32).reshape(batch.num_rows, -1)
    f = np.array(folds.to_pylist(), np.int32).reshape(batch.num_rows, -1)
    at_, value_ = at.flatten().to_numpy(zero_copy_only=False), value.flatten().to_numpy(zero_copy_only=False)
    begin = 0
    while begin < batch.num_rows:
        cells = np.arange(1, batch.num_rows - begin + 1) * np.minimum(ends[begin + 1 :] - ends[begin], size)
        end = begin + max(1, int(np.searchsorted(cells, CELLS, "right")))
        here, held = at_[ends[begin] : ends[end]], np.zeros(size, bool)
        held[here] = True
        own = np.flatnonzero(held)
        place = np.repeat(np.arange(end - begin) * len(own), lengths[begin:end]) + (np.cumsum(held) - 1)[here]
        x = np.bincount(place, value_[ends[begin] : ends[end]], (end - begin) * len(own)).astype(np.float32)
        yield slice(begin, end), own, x.reshape(end - begin, len(own)), y[begin:end], f[begin:end]
        begin = end


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """The blocks of ``matrix_rows``, stored: a pass over them decodes no lists and orders no features."""

    def pack(batches):
        import pyarrow as pa

        for b in batches:
            for _, own, x, y, f in _blocks(b, size):
                place = np.flatnonzero(x)
                held = [own.astype(np.int32), place.astype(np.int32), x.ravel()[place], y, f]
                yield pa.RecordBatch.from_arrays([pa.array([len(y)], pa.int32()), *[pa.array([h.tobytes()], pa.binary()) for h in held]], names=["n", "own", "place", "value", "labels", "folds"])

    return stored(rows.mapInArrow(pack, "n int, own binary, place binary, value binary, labels binary, folds binary"), "blocks")


def _unpacked(batch) -> Iterator[tuple]:
    """(own, x, labels, folds) of each of the blocks."""
    for i in range(batch.num_rows):
        n = batch.column(0)[i].as_py()
        own, place, value, y, f = (np.frombuffer(c[i].as_buffer(), kind) for c, kind in zip(batch.columns[1:], (np.int32, np.int32, np.float32, np.float32, np.int32), strict=True))
        x = np.zeros(n * len(own), np.float32)
        x[place] = value
        yield own, x.reshape(n, len(own)), y.reshape(n, -1), f.reshape(n, -1)


def _groups(own: np.ndarray, models: int) -> Iterator[slice]:
    """Models whose weights for a block's features are taken at once."""
    step = max(1, PRODUCTS // max(1, len(own)))
    return (slice(i, i + step) for i in range(0, models, step))


def _gradients(blocks: DataFrame, weights: np.ndarray, tag: np.ndarray, fold: np.ndarray, factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(losses, gradients) of all models in one pass; factor: weights of rows without and with a label, by model."""
    sent = blocks.sparkSession.sparkContext.broadcast(weights)
    features, models = weights.shape

    def work(batches):
        import pyarrow as pa

        total, loss, seen = np.zeros((features, models), np.float32), np.zeros(models), False
        for b in batches:
            for own, x, labels, folds in _unpacked(b):
                seen = True
                for some in _groups(own, models):
                    y, use = labels[:, tag[some]], folds[:, tag[some]] != fold[some]
                    z = x @ sent.value[own, some] + sent.value[-1, some]
                    c = np.where(y > 0, factor[1, some], factor[0, some]).astype(np.float32) * use
                    loss[some] += (c * (np.logaddexp(0, z) - y * z)).sum(0)
                    r = c * (1 / (1 + np.exp(-z)) - y)
                    total[-1, some] += r.sum(0)
                    total[own, some] += x.T @ r
        if seen:
            for i in range(0, features, FEATURES):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([total[i : i + FEATURES].tobytes()], pa.binary())], names=["at", "sums"])
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([loss.tobytes()], pa.binary())], names=["at", "sums"])

    def add(batches):
        import pyarrow as pa

        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for at, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = np.frombuffer(part, np.float32 if at >= 0 else np.float64)
                sums[at] = sums[at] + own if at in sums else own.astype(np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["at", "sums"])

    parts = blocks.mapInArrow(work, "at int, sums binary")
    width = max(1, min(blocks.rdd.getNumPartitions(), -(-features // FEATURES)))
    found = {r["at"]: np.frombuffer(r["sums"]) for r in parts.repartition(width, "at").mapInArrow(add, "at int, sums binary").collect()}
    sent.unpersist()
    loss = found.pop(-1, np.zeros(models))
    return loss, np.concatenate([found[i] for i in sorted(found)]).reshape(features, models) if found else np.zeros((features, models))


def fit(rows: DataFrame, strengths: list[float], k: int, size: int, iterations: int = 40, class_weights: bool = True) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """(weights, models) of ``matrix_rows``: a column of ``size`` + 1 weights, the last of them the intercept, for
    each model (label, strength, fold), which learns from the other folds.

    Each minimises its mean loss, classes weighted to equal shares, and 1 / (2 * c * n) of its squared weights.
    All take gradient steps together, of a length that each model's last two gradients give (Barzilai and Borwein);
    a step that raises a model's loss above its last five is taken back and halved twice.  Passes depend on
    ``iterations`` and, where the weights of all models exceed ``WEIGHTS``, on how many times they do.
    """
    counts: dict[tuple[int, int], list[int]] = {}
    each = rows.select(F.posexplode(F.arrays_zip("labels", "folds")).alias("tag", "x"))
    for r in each.groupBy("tag", "x.folds").agg(F.count_if(F.col("x.labels") > 0).alias("p"), F.count("*").alias("n")).collect():
        counts[r["tag"], r["folds"]] = [r["n"] - r["p"], r["p"]]
    tags = 1 + max((t for t, _ in counts), default=-1)
    models = [(t, s, f) for t in range(tags) for s in range(len(strengths)) for f in range(k)]
    out = np.zeros((size + 1, len(models)), np.float32)
    each_time, blocks = max(1, WEIGHTS // (size + 1)), _packed(rows, size)
    for i in range(0, len(models), each_time):
        some = models[i : i + each_time]
        train = np.array([[sum(counts.get((t, g), [0, 0])[y] for g in range(k) if g != f) for t, _, f in some] for y in (0, 1)], float)
        n = np.maximum(train.sum(0), 1)
        factor = n / np.maximum(2 * train, 1) if class_weights else np.ones_like(train)
        penalty = 1 / (np.array([strengths[s] for _, s, _ in some]) * n)
        out[:, i : i + each_time] = _descend(blocks, np.array([t for t, _, _ in some]), np.array([f for _, _, f in some]), factor / n, penalty, size, iterations)
    return out, models


def _descend(blocks, tag, fold, factor, penalty, size: int, iterations: int) -> np.ndarray:
    w = np.zeros((size + 1, len(tag)), np.float32)
    penalised = np.ones((size + 1, 1))
    penalised[-1] = 0

    def at(w):
        loss, g = _gradients(blocks, w, tag, fold, factor)
        return loss + 0.5 * penalty * (np.square(w[:-1], dtype=np.float64)).sum(0), g + penalty * penalised * w

    loss, g = at(w)
    step = 1 / (0.5 + penalty)  # the curvature's bound: rows are of length 1, the intercept adds 1, and weights sum to 1
    history = [loss]
    for _ in range(iterations):
        moved = (w - step * g).astype(np.float32)
        new_loss, new_g = at(moved)
        good = new_loss <= np.max(history[-5:], axis=0) + 1e-9
        s, d = np.where(good, moved - w, 0), np.where(good, new_g - g, 0)
        along = (s * d).sum(0)
        step = np.where(good & (along > 1e-20), np.clip((s * s).sum(0) / np.maximum(along, 1e-20), 1e-3, 1e6), np.where(good, step, step / 4))
        w, g, loss = np.where(good, moved, w), np.where(good, new_g, g), np.where(good, new_loss, loss)
        history.append(loss)
        if (np.abs(g).max(0) < 1e-6).all():
            break
    return w


def scores(rows: DataFrame, weights: np.ndarray, models: list[tuple[int, int, int]], key: str) -> DataFrame:
    """key, tag, strength (their numbers), label, fold, score: of each row, out of fold."""
    sent = rows.sparkSession.sparkContext.broadcast(weights)
    tag, strength, fold = (np.array([m[i] for m in models]) for i in range(3))

    def work(batches):
        import pyarrow as pa

        for b in batches:
            keys = b.column(b.schema.names.index(key))
            for some, own, x, y, f in _blocks(b, len(sent.value) - 1):
                z = np.concatenate([x @ sent.value[own, g] + sent.value[-1, g] for g in _groups(own, len(models))], axis=1)
                row, model = np.nonzero(f[:, tag] == fold)
                p = 1 / (1 + np.exp(-z[row, model].astype(np.float64)))
                yield pa.RecordBatch.from_arrays([keys.slice(some.start, some.stop - some.start).take(pa.array(row)), pa.array(tag[model], pa.int32()), pa.array(strength[model], pa.int32()), pa.array(y[row, tag[model]].astype(np.float64)), pa.array(fold[model], pa.int32()), pa.array(p)], names=[key, "tag", "strength", "label", "fold", "score"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(work, f"`{key}` {kind}, tag int, strength int, label double, fold int, score double")


def width(rows: DataFrame) -> int:
    """Features of ``matrix_rows``: one more than the largest number."""
    return 1 + int(rows.agg(F.max(F.array_max("at"))).first()[0] or 0)


def sigmoids(df: DataFrame, label: str, x: str, by: str, fold: str, rounds: int = 12) -> DataFrame:
    """(by, fold, slope, intercept): for each group and fold the sigmoid of ``x`` that the other folds' labels fit
    best, by Newton's steps: a pass for each step has the sums of all groups.  Groups and folds come to the driver.
    A group without both classes in the other folds has none."""
    spark = df.sparkSession
    own = df.select(F.col(by).alias("by"), F.col(fold).alias("fold"), F.col(x).alias("x"), (F.col(label) == 1).cast("double").alias("y"))
    sizes = own.groupBy("by", "fold").agg(F.sum("y").alias("p"), F.count("*").alias("n")).collect()
    others = lambda r, f: sum(f(q) for q in sizes if q["by"] == r["by"] and q["fold"] != r["fold"])
    known = {(r["by"], r["fold"]): (0.0, 0.0) for r in sizes if 0 < others(r, lambda q: q["p"]) < others(r, lambda q: q["n"])}
    for _ in range(rounds if known else 0):
        held = spark.createDataFrame([(b, f, s, i) for (b, f), (s, i) in known.items()], f"by {df.schema[by].dataType.simpleString()}, out {df.schema[fold].dataType.simpleString()}, slope double, intercept double")
        each = own.join(F.broadcast(held), "by").where("fold != out").withColumn("p", 1 / (1 + F.exp(-(F.col("slope") * F.col("x") + F.col("intercept")))))
        w = F.greatest(F.col("p") * (1 - F.col("p")), F.lit(1e-12))
        sums = each.groupBy("by", "out").agg(*[F.sum(e).alias(n) for n, e in {"g": (F.col("p") - F.col("y")) * F.col("x"), "h": F.col("p") - F.col("y"), "xx": w * F.col("x") * F.col("x"), "xw": w * F.col("x"), "ww": w}.items()])
        most = 0.0
        for r in sums.collect():
            # A small penalty keeps the slope finite where the classes are apart.
            s, i = known[r["by"], r["out"]]
            h, g = np.array([[r["xx"] + 1e-3, r["xw"]], [r["xw"], r["ww"] + 1e-6]]), np.array([r["g"] + 1e-3 * s, r["h"] + 1e-6 * i])
            step = np.clip(np.linalg.solve(h, g), -5, 5)
            known[r["by"], r["out"]] = (s - float(step[0]), i - float(step[1]))
            most = max(most, float(np.abs(step).max()))
        if most < 1e-7:
            break
    return spark.createDataFrame([(b, f, s, i) for (b, f), (s, i) in known.items()], f"`{by}` {df.schema[by].dataType.simpleString()}, `{fold}` {df.schema[fold].dataType.simpleString()}, slope double, intercept double")
