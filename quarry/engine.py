"""The engine over a folder of tables: index a source tree, search it, look at its topology."""

from __future__ import annotations

import os
import warnings

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .functions import paths as P
from .functions import providers, remote
from .functions import text as T
from .functions import vectors as V
from .operators import deps, graph, history, ingest, postings, search
from .operators.checkpoints import pinned
from .sources.catalog import Catalog
from .sources.files import read_files

#: What stands for a definition or a call of a name in source text.
DEFINITION = r"(?:fn|def|func|function|class|struct|trait|interface|type)\s+([A-Za-z_]\w*)"
REFERENCE = r"([A-Za-z_]\w*)\s*\("


class Engine:
    def __init__(self, spark: SparkSession, root: str, config: Config | None = None):
        self.spark, self.config = spark, config or Config()
        self.catalog = Catalog(spark, root, self.config.embedding.dimension).open()

    def embedder(self):
        """What makes a worker's client: of the service in the settings, else the offline stand-in. The key is read here, for executors may lack the variable."""
        e = self.config.embedding
        if not e.url:
            return lambda dimension=e.dimension: providers.hashed_embedder(dimension)
        client = remote.Embeddings(e.url, e.model, e.dimension, os.environ.get(e.key_variable) if e.key_variable else None, e.timeout_seconds)
        return lambda: client

    def reranker(self):
        """The reranking service of the settings, or None."""
        r = self.config.reranker
        if not r.url:
            return None
        return remote.Reranker(r.url, r.model, os.environ.get(r.key_variable) if r.key_variable else None, r.instruction or None, r.timeout_seconds)

    def _embedded(self, chunks: DataFrame) -> DataFrame:
        e = self.config.embedding
        return providers.embedded(chunks, self.embedder(), e.workers, e.requests_per_minute, e.tokens_per_minute, e.max_batch_size, e.context_length)

    def _index_words(self) -> None:
        """Postings and lengths of the chunks: those of chunks that stay are kept, for a chunk's id holds its content."""
        chunks, sizes = self.catalog.table("chunks").select("id", F.col("fts_text").alias("text")), self.catalog.table("chunk_lengths")
        gone, found = pinned(sizes.join(chunks, "id", "left_anti").select("id")), pinned(chunks.join(sizes, "id", "left_anti"))
        self.catalog.replace("postings", postings.laid_out(postings.upkept(self.catalog.table("postings"), gone, postings.postings(found).select("term", "id", "tf"))))
        self.catalog.replace("chunk_lengths", postings.upkept(sizes, gone, postings.lengths(found)))

    def index(self, folder: str) -> None:
        """Reads the tree, embeds chunks that are new by kind and hash, and replaces the tables; files come last, so an aborted run is done again."""
        below = os.path.relpath(self.catalog.root, folder).split(os.sep)
        if ":" not in folder and below[0] != ".." and not any(x.startswith((".", "_")) and x != "." for x in below):
            raise ValueError(f"the tables' folder {self.catalog.root} would be read as a part of {folder}: put it elsewhere, or give it a name that begins with a dot")
        c = self.config.chunking
        files = read_files(self.spark, folder, c.max_file_size)
        chunks = ingest.chunk_lines(files.select("path", "text"), c.lines, c.overlap).withColumns({"kind": F.lit("text"), "chunk_hash": F.sha2("text", 256)})
        chunks = chunks.withColumn("id", ingest.stable_id(F.col("path"), F.col("kind"), F.col("start_byte"), F.col("end_byte"), F.col("chunk_hash")))
        known = self.catalog.table("chunks").select("id", "kind", F.lower(F.hex("chunk_hash")).alias("chunk_hash"), "embedding")
        reused = ingest.reuse_embeddings(chunks, known)
        fresh = self._embedded(reused.where("embedding is null").select("id", "text")).withColumnRenamed("embedding", "made")
        full = reused.join(fresh, "id", "left").withColumn("embedding", F.coalesce("embedding", "made"))
        self.catalog.replace("chunks", full.select("id", F.col("path").alias("file_path"), "start_byte", "end_byte", F.unhex("chunk_hash").alias("chunk_hash"), "start_line", "end_line", "text", T.search_text(F.col("text")).alias("fts_text"), "kind", "ordinal", F.lit(None).cast("array<int>").alias("tokens"), "embedding"))
        self._index_words()
        names = ingest.extract_symbols(chunks, DEFINITION, REFERENCE).withColumns({"file_path": F.col("path"), "language": P.extension(F.col("path"))})
        self.catalog.replace("symbols", names.where("kind = 'definition'").select("id", "file_path", "name", "kind", "start_byte", "end_byte", "language"))
        self.catalog.replace("symbol_references", names.where("kind = 'reference'").select("id", "file_path", "name", "start_byte", "end_byte", "language"))
        named = lambda t: self.catalog.table(t).select(F.col("file_path").alias("path"), "name", "id")
        self.catalog.replace("reference_symbol_edges", deps.unique_links(named("symbol_references"), named("symbols")))
        side = lambda t: self.catalog.table(t).select(F.col("file_path").alias("path"), "name")
        self.catalog.replace("file_dependency_edges", deps.edges(side("symbol_references"), side("symbols")))
        self.catalog.replace("files", files.select("path", F.unhex("content_hash").alias("content_hash"), "size", P.extension(F.col("path")).alias("primary_language"), F.current_timestamp().alias("updated_at")))
        self.catalog.note("root", folder)

    def index_history(self, commits: DataFrame) -> None:
        """commits(commit_id, path): pairs of known files weigh one over all files of their commit; earlier edges stay."""
        known = self.catalog.table("files").select("path")
        edges = history.file_commit_edges(commits)
        sizes = history.small_commits(edges, known.count(), self.config.history.commit_size_limit_ratio)
        edges = edges.join(sizes.select("commit_id"), "commit_id", "left_semi").join(known, "path", "left_semi")
        old = self.catalog.table("file_cochange_edges")
        self.catalog.replace("file_cochange_edges", history.upsert_edges(old, history.cochange_edges(edges, sizes)))
        self.catalog.replace("file_commit_edges", self.catalog.table("file_commit_edges").unionByName(edges.select(F.col("path").alias("file_path"), "commit_id")).distinct())

    def search(self, query: str, prefixes: list[str] | None = None, extensions: list[str] | None = None, min_score: float | None = None) -> DataFrame:
        """(id, path, score, ...) of the best chunks; filters, and the least score (that of the settings, unless given), apply after the limit.

        A reranking service, if there is one, scores what the filters leave anew.
        """
        s = self.config.search
        least = s.min_score if min_score is None else min_score
        chunks = self.catalog.table("chunks")
        vector = self.spark.createDataFrame([(self.embedder()()([query])[0],)], "embedding array<float>")
        near = search.vector_topk(chunks.select("id", "embedding"), vector, s.limit).where(~F.isnan("distance"))
        terms = self.spark.range(1).select(T.query_terms(F.lit(query)).alias("t")).first()["t"]
        words = self._found_by_words(terms, s.limit)
        hits = search.hybrid(near, words, s.hybrid_weight, s.limit).join(chunks.select("id", F.col("file_path").alias("path"), "start_byte", "end_byte", "text"), "id")
        kept = hits.where(P.in_prefixes(F.col("path"), prefixes or []) & P.in_extensions(F.col("path"), extensions or []))
        client = self.reranker()
        if client is None:
            return kept.where(V.clamp(F.col("score")) >= least).orderBy(F.desc("score"), "id")
        kept = pinned(kept)
        rows = kept.orderBy(F.desc("score"), "id").limit(s.limit).select("id", "text").collect()  # at most the limit
        scores = client(query, [r["text"] for r in rows])
        if len(scores) != len(rows):
            raise ValueError(f"{len(scores)} scores came for {len(rows)} results")
        given = self.spark.createDataFrame([(r["id"], x) for r, x in zip(rows, scores, strict=True)], "id string, rerank double")
        return search.reranked(kept, F.lit(True), given, s.limit, least).drop("rerank")

    def _found_by_words(self, terms: list[str], k: int) -> DataFrame:
        """Hits from the postings (of the chunks themselves in a folder from before there were postings); none, with a warning, if they cannot be read."""
        try:
            if self.catalog.has("chunk_lengths"):
                return pinned(postings.fts_topk(self.catalog.table("postings"), self.catalog.table("chunk_lengths"), terms, k))
            return pinned(search.fts_topk(self.catalog.table("chunks").select("id", F.col("fts_text").alias("text")), terms, k))
        except (PySparkException, Py4JJavaError) as e:
            warnings.warn(f"full-text search unavailable: {e}", stacklevel=2)
            return self.spark.createDataFrame([], "id string, fts_score double")

    def edges(self) -> DataFrame:
        return self.catalog.table("file_dependency_edges").select("src", "dst", F.col("reference_count").alias("weight"))

    def topology(self) -> DataFrame:
        return graph.stats(self.edges(), self.catalog.table("files").select("path"))
