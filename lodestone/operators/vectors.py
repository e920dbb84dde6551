"""Vector search, fusion, quantisation and pruning over embedding tables (doc_id, embedding)."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.scoring import RRF_K, RRF_LEXICAL, RRF_SEMANTIC, cosine, dot, norm, vector_literal

from .retrieval import ranked

PRUNING_THRESHOLD = 0.95


def inner_products(docs: DataFrame, query: list[float], qid: object = 0, column: str = "embedding") -> DataFrame:
    return docs.where(F.col(column).isNotNull()).select(F.lit(qid).alias("qid"), "doc_id", dot(F.col(column), vector_literal(query)).alias("score"))


def knn(docs: DataFrame, query: list[float], k: int, qid: object = 0, column: str = "embedding") -> DataFrame:
    """The k documents of largest inner product, exactly; fewer if there are fewer."""
    return ranked(inner_products(docs, query, qid, column), k, by=F.col("score"))


def prune_by_distance(docs: DataFrame, query: list[float], threshold: float = PRUNING_THRESHOLD) -> DataFrame:
    return inner_products(docs, query).where(F.col("score") >= threshold)


def file_geometry(docs: DataFrame, file: str) -> DataFrame:
    """file_path, doc_count, unit centroid and radius of the vectors of each file.

    Means are partial sums by dimension, so a file of any size is never in one place.
    """
    by_dim = docs.select(F.col(file).alias("file_path"), F.posexplode("embedding").alias("dim", "x")).groupBy("file_path", "dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    mean = by_dim.groupBy("file_path").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("mean"))
    centre = mean.select("file_path", F.transform("mean", lambda x: x / (norm(F.col("mean")) + 1e-10)).alias("centroid"))
    away = F.sqrt(F.aggregate(F.zip_with("embedding", "centroid", lambda x, c: F.pow(x.cast("double") - c, F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))
    far = docs.withColumn("file_path", F.col(file)).join(centre, "file_path").groupBy("file_path").agg(F.count(F.lit(1)).alias("doc_count"), F.max(away).alias("radius"))
    return far.join(centre, "file_path").select("file_path", "doc_count", "centroid", "radius")


def geometric_prune(files: DataFrame, query: list[float], threshold: float) -> DataFrame:
    """Files that may hold a vector within threshold of the unit query: distance of centroid less radius."""
    size = float(np.sqrt(sum(x * x for x in query)))
    unit = vector_literal([x / (size + 1e-10) for x in query])
    away = F.sqrt(F.aggregate(F.zip_with(unit, "centroid", lambda x, c: F.pow(x - c, F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))
    return files.withColumn("distance", away).where(F.col("distance") - F.col("radius") <= threshold)


def pruned_knn(docs: DataFrame, file: str, files: DataFrame, query: list[float], k: int, threshold: float) -> DataFrame:
    """knn over the files that geometry leaves; on a partitioned table the others are not read."""
    left = geometric_prune(files, query, threshold).select(F.col("file_path").alias(file))
    return knn(docs.join(left, file, "left_semi"), query, k)


def quantize_i8(docs: DataFrame) -> DataFrame:
    """doc_id, codes, vmin, vmax: bytes by the range of all values, cut towards zero; zeros if all are equal."""
    span = docs.select(F.array_min("embedding").alias("lo"), F.array_max("embedding").alias("hi")).agg(F.min("lo").cast("double").alias("vmin"), F.max("hi").cast("double").alias("vmax"))
    rows = docs.withColumns({c: span.select(c).scalar() for c in ("vmin", "vmax")})
    code = F.transform("embedding", lambda x: F.when(F.col("vmax") > F.col("vmin"), ((x.cast("double") - F.col("vmin")) / (F.col("vmax") - F.col("vmin")) * 255 - 128).cast("tinyint")).otherwise(F.lit(0).cast("tinyint")))
    return rows.select("doc_id", code.alias("codes"), "vmin", "vmax")


def dequantize_i8(quantised: DataFrame) -> DataFrame:
    back = F.transform("codes", lambda c: ((c.cast("double") + 128) / 255 * (F.col("vmax") - F.col("vmin")) + F.col("vmin")).cast("float"))
    return quantised.select("doc_id", back.alias("embedding"))


def quantize_f16(docs: DataFrame) -> DataFrame:
    """Vectors rounded to half precision."""

    @F.pandas_udf("array<float>")
    def half(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else np.asarray(x, np.float16).astype(np.float32))

    return docs.select("doc_id", half("embedding").alias("embedding"))


def rrf(lexical: DataFrame, semantic: DataFrame, k: int = RRF_K, w_lexical: float = RRF_LEXICAL, w_semantic: float = RRF_SEMANTIC) -> DataFrame:
    """Weighted reciprocal ranks of lexical hits; those without a vector rank last with -1."""
    both = lexical.select("qid", "doc_id", F.col("score").alias("lexical")).join(semantic.select("qid", "doc_id", F.col("score").alias("semantic")), ["qid", "doc_id"], "left")
    both = both.withColumn("semantic", F.coalesce("semantic", F.lit(-1.0)))
    by = lambda c: F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(c), "doc_id"))
    out = both.withColumns({"lexical_rank": by("lexical").cast("bigint"), "semantic_rank": by("semantic").cast("bigint")})
    return out.withColumn("score", w_lexical / (k + F.col("lexical_rank")) + w_semantic / (k + F.col("semantic_rank")))


def cosines(docs: DataFrame, query: list[float], qid: object = 0) -> DataFrame:
    return docs.select(F.lit(qid).alias("qid"), "doc_id", cosine(F.col("embedding"), vector_literal(query)).alias("score"))


def dual_hybrid(docs: DataFrame, query: list[float], k: int, w_content: float = 0.5, w_context: float = 0.5) -> DataFrame:
    """Weighted sum of two vector searches (content, context), each cut at 2 k."""
    parts = [knn(docs, query, 2 * k, column=c).select("qid", "doc_id", (F.col("score") * w).alias("score")) for c, w in (("content", w_content), ("context", w_context))]
    return ranked(parts[0].unionByName(parts[1]).groupBy("qid", "doc_id").agg(F.sum("score").alias("score")), k, by=F.col("score"))


def dual_boosted(hits: DataFrame, dual: DataFrame, weight: float = 0.3) -> DataFrame:
    """Scores raised by a part of the dual score, to be ranked anew."""
    d = dual.select("qid", "doc_id", (F.col("score") * weight).alias("_dual"))
    return hits.join(d, ["qid", "doc_id"], "left").withColumn("score", F.col("score") + F.coalesce("_dual", F.lit(0.0))).drop("_dual")


def dual_texts(docs: DataFrame) -> DataFrame:
    """The texts to embed: content, and context of title, section, summary and beginning."""
    some = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c)
    parts = [some(F.col(c)) if c in docs.columns else F.lit(None).cast("string") for c in ("title", "section", "summary")]
    return docs.select("doc_id", F.substring("text", 1, 512).alias("content"), F.concat_ws(" ", *parts, some(F.substring("text", 1, 300))).alias("context"))


def hashed_words(texts: pd.Series, dim: int) -> pd.Series:
    """Unit vectors of words dealt to dimensions and signs by a checksum: the offline default model."""
    import zlib

    out = []
    for t in texts:
        v = np.zeros(dim, np.float32)
        for w in (t or "").lower().split():
            h = zlib.crc32(w.encode())
            v[h % dim] += 1.0 if h >> 16 & 1 else -1.0
        size = float(np.linalg.norm(v))
        out.append(v / size if size else v)
    return pd.Series(out)


def embed_text(c: Column | str, dim: int = 384, model: Callable[[pd.Series, int], pd.Series] = hashed_words) -> Column:
    """Embedding of a text; any batch model of the same signature can take the place of the default."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return model(texts, dim)

    return run(c)


# Above so many vectors a kind of index is taken.
GPU_LEAST, IVF_LEAST, HNSW_LEAST = 100_000, 500_000, 10_000


def select_index(n_vectors: int, *, has_gpu: bool = False) -> str:
    """Kind of index by number of vectors."""
    if has_gpu and n_vectors > GPU_LEAST:
        return "gpu_ivf_pq"
    return "ivf_pq" if n_vectors > IVF_LEAST else "hnsw" if n_vectors > HNSW_LEAST else "flat"


def index_kind(n: Column, has_gpu: bool = False) -> Column:
    """select_index as an expression over counts."""
    plain = F.when(n > IVF_LEAST, "ivf_pq").when(n > HNSW_LEAST, "hnsw").otherwise("flat")
    return F.when((n > GPU_LEAST) & F.lit(has_gpu), "gpu_ivf_pq").otherwise(plain)


def lsh_knn(docs: DataFrame, query: list[float], k: int, *, tables: int = 8, bucket: float = 2.0, seed: int = 7) -> DataFrame:
    """Approximate search by random projections: candidates share a bucket, scores are exact inner products."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    vectors = docs.select("doc_id", "embedding", array_to_vector("embedding").alias("v"))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="hashes", bucketLength=bucket, numHashTables=tables, seed=seed).fit(vectors)
    near = model.approxNearestNeighbors(vectors, Vectors.dense(query), 4 * k)
    return knn(near.select("doc_id", "embedding"), query, k)


class IvfPq:
    """Inverted cells with product-quantised residual-free codes.

    Cells and code books are trained by k-means on a sample of at most train_rows rows;
    every row is indexed. Cells and codes are columns, so probing is a filter on cell.

    Of n rows there are sqrt(n) cells if nlist is None (MIN_CELLS at least). A search probes
    PROBED of them and scores n * RERANKED rows exactly if it isn't told otherwise, so its
    recall doesn't fall as the table grows.
    """

    MIN_CELLS, PROBED, RERANKED = 16, 0.75, 0.02

    def __init__(self, nlist: int | None = None, m: int = 16, codes: int = 64, train_rows: int = 20_000, seed: int = 7):
        self.nlist, self.m, self.codes, self.train_rows, self.seed = nlist, m, codes, train_rows, seed

    def _kmeans(self, x: np.ndarray, k: int) -> np.ndarray:
        rng = np.random.default_rng(self.seed)
        centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
        for _ in range(12):
            near = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1) if len(x) * len(centres) * x.shape[1] < 5e7 else (-2 * x @ centres.T + (centres**2).sum(axis=1)).argmin(axis=1)
            for c in range(len(centres)):
                if (near == c).any():
                    centres[c] = x[near == c].mean(axis=0)
        return centres

    def fit(self, docs: DataFrame) -> IvfPq:
        sample = docs.orderBy(F.xxhash64("doc_id"), "doc_id").limit(self.train_rows).select("embedding").toPandas()["embedding"]
        x = np.array(sample.tolist(), float)
        self.n_rows = len(x) if len(x) < self.train_rows else docs.count()
        nlist = self.nlist or max(self.MIN_CELLS, math.isqrt(self.n_rows))
        self.cells = self._kmeans(x, nlist if len(x) >= nlist else max(2, len(x) // 2))
        self.width = x.shape[1] // self.m
        self.books = [self._kmeans(x[:, k * self.width : (k + 1) * self.width], self.codes) for k in range(self.m)]
        return self

    def index(self, docs: DataFrame) -> DataFrame:
        cells, books, width = self.cells, self.books, self.width

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                x = np.array(p["embedding"].tolist(), float).reshape(len(p), -1)
                cell = (-2 * x @ cells.T + (cells**2).sum(axis=1)).argmin(axis=1)
                codes = np.stack([(-2 * x[:, k * width : (k + 1) * width] @ b.T + (b**2).sum(axis=1)).argmin(axis=1) for k, b in enumerate(books)], axis=1)
                yield pd.DataFrame({"doc_id": p["doc_id"], "cell": cell.astype("int32"), "codes": list(codes.astype("int16"))})

        return docs.select("doc_id", "embedding").mapInPandas(run, "doc_id long, cell int, codes array<smallint>")

    def search(self, index: DataFrame, query: list[float], k: int, nprobe: int | None = None, rerank: DataFrame | None = None, widen: int = 8) -> DataFrame:
        """Inner products looked up by code; with rerank (docs), widen * k of them or the share RERANKED of all rows, whichever is more, are scored exactly."""
        q = np.array(query, float)
        nprobe = nprobe or max(8, math.ceil(self.PROBED * len(self.cells)))
        probe = (self.cells @ q).argsort()[::-1][: min(nprobe, len(self.cells))].tolist()
        tables = [vector_literal((b @ q[n * self.width : (n + 1) * self.width]).tolist()) for n, b in enumerate(self.books)]
        score = sum((F.element_at(t, F.element_at("codes", n + 1).cast("int") + 1) for n, t in enumerate(tables)), F.lit(0.0))
        hits = index.where(F.col("cell").isin(probe)).select(F.lit(0).alias("qid"), "doc_id", score.alias("score"))
        if rerank is None:
            return ranked(hits, k, by=F.col("score"))
        some = ranked(hits, max(widen * k, math.ceil(self.RERANKED * self.n_rows)), by=F.col("score")).select("doc_id")
        return knn(rerank.join(some, "doc_id", "left_semi"), query, k)
