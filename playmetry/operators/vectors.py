"""Filtered cosine search and text vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playmetry.operators.features import profile_text, user_profile
from playmetry.operators.frames import top_per_key

SCORE_DIGITS = 9


def _norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two float arrays in double precision."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return dot / F.nullif(_norm(a) * _norm(b), F.lit(0.0))


def top_k_cosine(vectors: DataFrame, query: Sequence[float], k: int) -> DataFrame:
    """Nearest `k` vectors to one query; equal scores go by id. The sort is a top-n."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.withColumn("score", F.round(cosine(F.col("embedding"), q), SCORE_DIGITS))
    return scored.drop("embedding").orderBy(F.col("score").desc(), "id").limit(k)


def similar_items(vectors: DataFrame, item_id, k: int, where: Column | None = None) -> DataFrame:
    """Neighbours of a stored vector without itself; no rows when the id is not stored.

    The stored vector is one row (the id is a key), read as a scalar subquery.
    """
    stored = vectors.where(F.col("id") == F.lit(item_id)).select("embedding").limit(1).scalar()
    pool = vectors.where(F.col("id") != F.lit(item_id))
    if where is not None:
        pool = pool.where(where)
    scored = pool.withColumn("__q", stored).withColumn(
        "score", F.round(cosine(F.col("embedding"), F.col("__q")), SCORE_DIGITS)
    )
    found = scored.where(F.col("score").isNotNull()).drop("embedding", "__q")
    return found.orderBy(F.col("score").desc(), "id").limit(k)


def filtered_search(
    vectors: DataFrame,
    query: Sequence[float],
    k: int,
    max_level: int | None = None,
    any_tags: Sequence[str] | None = None,
) -> DataFrame:
    """Payload filters first, then the nearest `k`."""
    kept = vectors if max_level is None else vectors.where(F.col("level") <= max_level)
    if any_tags:
        kept = kept.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in any_tags])))
    return top_k_cosine(kept, query, k)


#: Bytes that the vectors of one block of users or items may take in a task.
CELL_BYTES = 32 << 20
#: Blocks of a side at most, as long as none takes more than CELL_BYTES: a row is sent to one cell per block of the other side.
BLOCKS = 16
#: Scores that a task holds at once.
TILE = 1 << 22


def _blocks(n_bytes: int, cell_bytes: int) -> int:
    """Blocks of about `cell_bytes`. Beyond BLOCKS they grow up to CELL_BYTES, so that what is sent grows as the input."""
    return max(1, min(-(-n_bytes // cell_bytes), max(BLOCKS, -(-n_bytes // CELL_BYTES))))


def items_for_users(users: DataFrame, items: DataFrame, seen: DataFrame, k: int, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """Exact nearest `k` unseen items of every user in `users`, a given list of asks.

    Users and items are hashed into blocks (`_blocks`), so the number of blocks follows from
    the row counts and the result does not depend on it; each (user block, item block) cell
    is one task that multiplies two matrices and keeps `k` items per user. Only those leave
    the task, and a last rank joins the cells. Seen pairs go straight to their one cell, so
    they are removed before anything is cut. Vectors are sent as they are stored. The work is
    users x items; what is sent is BLOCKS times the input at most while a block is under
    CELL_BYTES, and users x items / CELL_BYTES beyond.
    """

    def blocks(df: DataFrame) -> int:
        n, width = df.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
        return _blocks(n * (width or 1) * 8, cell_bytes)

    def block(col: Column, n: int) -> Column:
        return F.pmod(F.xxhash64(col), F.lit(n)).cast("int")

    user_blocks, item_blocks = blocks(users), blocks(items)
    vec, none = F.col("embedding"), F.lit(None).cast("long")
    asks = users.select(
        F.col("id").alias("user_id"), none.alias("item_id"), vec.alias("v"),
        block(F.col("id"), user_blocks).alias("ub"),
        F.explode(F.sequence(F.lit(0), F.lit(item_blocks - 1))).alias("ib"),
    )
    had = seen.select(
        "user_id", "item_id", F.lit(None).cast(users.schema["embedding"].dataType).alias("v"),
        block(F.col("user_id"), user_blocks).alias("ub"),
        block(F.col("item_id"), item_blocks).alias("ib"),
    )
    offers = items.select(
        F.col("id").alias("item_id"), vec.alias("v"),
        F.explode(F.sequence(F.lit(0), F.lit(user_blocks - 1))).alias("ub"),
        block(F.col("id"), item_blocks).alias("ib"),
    )
    left = asks.unionByName(had).groupBy("ub", "ib")
    cells = left.cogroup(offers.groupBy("ub", "ib")).applyInPandas(
        _best_in_cell(k), "user_id long, item_id long, score double"
    )
    order = [F.col("score").desc(), F.col("item_id").asc()]
    return top_per_key(cells, ["user_id"], order, k)


def _best_in_cell(k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def unit(vectors: pd.Series) -> np.ndarray:
        m = np.stack(vectors.to_numpy()).astype(float)
        norms = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)

    def best(left: pd.DataFrame, offers: pd.DataFrame) -> pd.DataFrame:
        asks, had = left[left["item_id"].isna()], left[left["item_id"].notna()]
        columns = ["user_id", "item_id", "score"]
        if asks.empty or offers.empty:
            return pd.DataFrame({c: [] for c in columns}).astype({"user_id": "int64", "item_id": "int64", "score": "float64"})
        users, ids = asks["user_id"].to_numpy(), offers["item_id"].to_numpy()
        by_id = np.argsort(ids)
        ids, item_matrix = ids[by_id], unit(offers["v"])[by_id].T
        # Places of the seen pairs in the matrix of scores; users and items may repeat.
        places = had[["user_id", "item_id"]].merge(pd.DataFrame({"user_id": users, "row": np.arange(len(users))}), on="user_id")
        places = places.astype({"item_id": "int64"}).merge(pd.DataFrame({"item_id": ids, "col": np.arange(len(ids))}), on="item_id").sort_values("row")
        rows_at, cols_at = places["row"].to_numpy(), places["col"].to_numpy()
        groups = np.arange(0, len(ids), 64)
        out, many = [], max(1, TILE // len(ids))
        for start in range(0, len(users), many):
            scores = unit(asks["v"].iloc[start : start + many]) @ item_matrix
            a, b = np.searchsorted(rows_at, [start, start + many])
            scores[rows_at[a:b] - start, cols_at[a:b]] = -np.inf
            # k groups of items reach the k-th of the groups' best scores, so the k-th score is no less; only
            # what may round to as much is rounded and ordered.
            least = np.full(len(scores), -np.inf)
            if k < len(groups):
                best_of = np.fmax.reduceat(scores, groups, axis=1)
                least = np.partition(best_of, len(groups) - k, axis=1)[:, -k] - 2 * 10.0**-SCORE_DIGITS
            place = np.flatnonzero(scores >= least[:, None])
            place = place[scores.ravel()[place] > -np.inf]
            row, col = np.divmod(place, len(ids))
            value = np.round(scores[row, col], SCORE_DIGITS)
            order = np.lexsort((ids[col], -value, row))
            row, col, value = row[order], col[order], value[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            top = place < k
            out.append(pd.DataFrame({"user_id": users[start + row[top]], "item_id": ids[col[top]], "score": value[top]}))
        return pd.concat(out)

    return best


# ---------------------------------------------------------------- large x large, by hashing

#: Hash tables, buckets that a user looks into per table, items aimed at per bucket, rows of a cell side.
TABLES, PROBES, PER_BUCKET, CELL_ROWS = 8, 4, 32, 4096


def _hyperplanes(dim: int, tables: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(dim, tables * bits))


def bucketed(vectors: DataFrame, dim: int, tables: int, bits: int, probes: int = 1, seed: int = 7) -> DataFrame:
    """(id, v, t, bucket): the bucket of every vector in each table, and of the `probes` - 1 most
    likely neighbouring buckets.

    A bucket is the signs of `bits` random projections. A neighbour differs where projections
    are nearest to 0: sets of one or two flipped signs go by their sum of squares.
    """
    planes = _hyperplanes(dim, tables, bits, seed)
    ones = [(i,) for i in range(bits)] + [(i, j) for i in range(bits) for j in range(i)]
    flips = np.zeros((len(ones) + 1, bits))
    for n, places in enumerate(ones):
        flips[n + 1, list(places)] = 1
    masks = (flips @ (2.0 ** np.arange(bits))).astype(np.int64)
    probes = min(probes, len(masks))

    def place(batches):
        for batch in batches:
            ids = batch.column(0)
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim)
            norms = np.linalg.norm(v, axis=1, keepdims=True)
            v = np.divide(v, norms, out=np.zeros_like(v), where=norms > 0)
            for t in range(tables):
                near = v @ planes[:, t * bits : (t + 1) * bits]
                bucket = (near > 0) @ (2 ** np.arange(bits, dtype=np.int64))
                cost = (near**2) @ flips.T
                chosen = masks[np.argsort(cost, axis=1, kind="stable")[:, :probes]]
                n = np.repeat(np.arange(batch.num_rows), probes)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(n)),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * dim), pa.array(v[n].ravel())),
                        pa.array(np.full(len(n), t, np.int32)),
                        pa.array((bucket[:, None] ^ chosen).ravel()),
                    ],
                    names=["id", "v", "t", "bucket"],
                )

    usable = F.size("embedding") == dim
    rows = vectors.where(usable).select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return rows.mapInArrow(place, "id long, v array<double>, t int, bucket long")


def hash_shape(items: DataFrame, per_bucket: int = PER_BUCKET) -> tuple[int, int]:
    """(components, bits): about `per_bucket` items fall into a bucket, with 20 bits at most."""
    n, dim = items.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    return dim or 1, int(min(20, max(1, np.ceil(np.log2(max(n / per_bucket, 2))))))


def pairs_looked_at(users: DataFrame, items: DataFrame, tables: int = TABLES, probes: int = PROBES, per_bucket: int = PER_BUCKET) -> DataFrame:
    """One row: (user, item) pairs that meet in a bucket, repeats counted, and all pairs."""
    dim, bits = hash_shape(items, per_bucket)
    left, right = (bucketed(df, dim, tables, bits, p).groupBy("t", "bucket").agg(F.count(F.lit(1)).alias(n)) for df, p, n in ((users, probes, "u"), (items, 1, "i")))
    whole = users.agg(F.count(F.lit(1))).scalar() * items.agg(F.count(F.lit(1))).scalar()
    return left.join(right, ["t", "bucket"]).agg(F.sum(F.col("u") * F.col("i")).alias("looked_at"), F.max(whole).alias("all_pairs"))


def items_for_users_hashed(
    users: DataFrame, items: DataFrame, seen: DataFrame, k: int, tables: int = TABLES, probes: int = PROBES, per_bucket: int = PER_BUCKET, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """Nearest `k` unseen items of every user among those that share a bucket with it, for many
    users and many items: (user_id, item_id, score, rank as in `items_for_users`).

    Random-projection buckets are the source of candidates (`bucketed`: items lie in one
    bucket per table, users look into `probes`), and candidates are ranked by exact cosines.
    A bucket is dealt into cells of about `cell_rows` users and items, so a bucket with many
    equal vectors is many tasks; each cell multiplies two matrices and hands on k items per
    user and as many more as the user has seen, from which the seen ones are taken out
    before the cut. Recall is measured in the tests; `items_for_users` is the exact way.
    """
    dim, bits = hash_shape(items, per_bucket)
    had = seen.groupBy("user_id").agg(F.count(F.lit(1)).alias("had"))
    asking = users.join(had, users["id"] == had["user_id"], "left").select(users["id"], "embedding", F.coalesce("had", F.lit(0)).alias("had"))
    offers, asks = bucketed(items, dim, tables, bits), bucketed(asking, dim, tables, bits, probes)
    asks = asks.join(asking.select("id", "had"), "id")

    def blocks(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("t", "bucket").agg(F.ceil(F.count(F.lit(1)) / cell_rows).cast("int").alias(name))

    # One row per bucket that both sides have: at most tables * 2^bits, and 20 bits at most.
    shape = blocks(asks, "ubs").join(blocks(offers, "ibs"), ["t", "bucket"])

    def dealt(df: DataFrame, own: str, other: str, n: str, all_of: str) -> DataFrame:
        spread = df.join(shape, ["t", "bucket"]).withColumn(own, F.pmod(F.xxhash64("id"), F.col(n)).cast("int"))
        return spread.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(all_of) - 1))).drop("ubs", "ibs")

    cell = ["t", "bucket", "ub", "ib"]
    left = dealt(asks, "ub", "ib", "ubs", "ibs").groupBy(*cell)
    right = dealt(offers, "ib", "ub", "ibs", "ubs").groupBy(*cell)

    def best(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(mine) and len(theirs):
            theirs = theirs.sort_values("id")
            ids, matrix = theirs["id"].to_numpy(), np.stack(theirs["v"].to_numpy()).T
            users_, want = mine["id"].to_numpy(), k + mine["had"].to_numpy()
            for a in range(0, len(users_), 256):
                scores = np.round(np.stack(mine["v"].iloc[a : a + 256].to_numpy()) @ matrix, SCORE_DIGITS)
                order = np.argsort(-scores, axis=1, kind="stable")
                row, place = np.nonzero(np.arange(len(ids))[None, :] < want[a : a + 256, None])
                col = order[row, place]
                out.append((users_[a + row], ids[col], scores[row, col]))
        return pd.DataFrame(dict(zip(("user_id", "item_id", "score"), map(np.concatenate, zip(*out)))))

    found = left.cogroup(right).applyInPandas(best, "user_id long, item_id long, score double")
    once = found.groupBy("user_id", "item_id").agg(F.max("score").alias("score"))
    unseen = once.join(seen.select("user_id", "item_id").distinct(), ["user_id", "item_id"], "left_anti")
    return top_per_key(unseen, ["user_id"], [F.col("score").desc(), F.col("item_id").asc()], k)


#: Words that a task keeps the buckets of, before it starts anew.
KNOWN_WORDS = 1 << 20


def hashed_words(dim: int):
    """Unit vector of the word counts of a text: a word (split at ASCII white space, lower case)
    falls into the bucket that the first four bytes of its MD5 give. Without words: zeros."""

    class Buckets(dict):
        def __missing__(self, word: bytes) -> int:
            bucket = self[word] = int.from_bytes(hashlib.md5(word).digest()[:4], "big") % dim
            return bucket

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = Buckets()  # a word is hashed once per task
        for texts in batches:
            if len(known) > KNOWN_WORDS:
                known.clear()
            out = []
            for text in texts:
                words = (text or "").lower().encode().split()
                counts = np.bincount(np.fromiter(map(known.__getitem__, words), np.int64, len(words)), minlength=dim).astype(float)
                norm = np.sqrt((counts * counts).sum())
                out.append((counts / norm if norm else counts).astype(np.float32))
            yield pd.Series(out)

    return F.pandas_udf(run, "array<float>")


def embed_text(df: DataFrame, col: str, dim: int = 384, embedder=None, out: str = "embedding") -> DataFrame:
    """Unit vector of a text column. The default hashes words; pass a `pandas_udf` from
    string to array<float> as `embedder` to use a sentence model."""
    return df.withColumn(out, (embedder or hashed_words(dim))(F.col(col)))


def search_by_technique(
    items: DataFrame, techniques: Sequence[str], k: int, difficulty: str | None = None, dim: int = 384, embedder=None
) -> DataFrame:
    """Nearest `k` items (id, embedding, difficulty) to the descriptor of a puzzle with the given
    techniques, of one difficulty if that is given. The descriptor is one row, embedded like
    the items were, and read as a scalar subquery."""
    spark = items.sparkSession
    text = "Sudoku puzzle" + (f": difficulty={difficulty}" if difficulty else "") + f", techniques={', '.join(techniques)}"
    asked = embed_text(spark.createDataFrame([(text,)], "text string"), "text", dim, embedder, "__asked").select("__asked")
    pool = items if difficulty is None else items.where(F.col("difficulty") == difficulty)
    scored = pool.withColumn("__q", asked.scalar()).withColumn("score", F.round(cosine(F.col("embedding"), F.col("__q")), SCORE_DIGITS))
    found = scored.where(F.col("score").isNotNull()).drop("embedding", "__q")
    return found.orderBy(F.col("score").desc(), "id").limit(k)


def aggregate_profile_vector(sessions: DataFrame, dim: int = 384, embedder=None) -> DataFrame:
    """Vector of each user's profile text."""
    return embed_text(profile_text(user_profile(sessions)), "text", dim, embedder)
