"""The index as an object: tables of postings, blocks, summaries and radii, with search and updates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sablevec.operators import graph, index, metrics, projection, search, updates
from sablevec.plans.config import Config, Search
from sablevec.session import materialise

TABLES = ("docs", "blocks", "sizes", "summary", "radii", "tombstones")
OPTIONAL = ("jlt", "knn", "vocabulary", "names")


class SparseIndex:
    """Tables of one index. ``docs``: (d, c, v); ``blocks``: (c, b, d); ``sizes``: (c, b, n); ``summary``: (c, b, c2, v);
    ``radii``: (c, b, radius); ``tombstones``: (d); optional: ``jlt``, ``knn``, ``vocabulary`` (token, id), ``names`` (d, name)."""

    def __init__(self, config: Config, **tables: DataFrame | None):
        self.config = config
        for name in (*TABLES, *OPTIONAL):
            setattr(self, name, tables.get(name))

    # building, keeping

    @classmethod
    def build(cls, docs: DataFrame, config: Config | None = None, keep: bool = True) -> SparseIndex:
        """From rows (d, c, v). ``keep``: write each table once to the shared folder."""
        config = config or Config()
        spark = docs.sparkSession
        save = materialise if keep else lambda df, _: df
        docs = save(docs.select(F.col("d").cast("bigint").alias("d"), F.col("c").cast("int").alias("c"), F.col("v").cast("double").alias("v")), "docs")
        pruned = index.prune_fixed(docs, config.n_postings) if config.pruning == "fixed" else index.prune_global(docs, config.n_postings, config.max_fraction)
        if config.blocking == "chunks":
            blocks = index.block_chunks(pruned, config.block_size)
        elif config.blocking == "round_robin":
            blocks = index.block_round_robin(pruned, config.centroid_fraction)
        else:
            blocks = index.block_representatives(pruned, docs, config.representatives, config.seed, config.doc_cut)
        blocks = save(blocks, "blocks")
        out = cls(config, docs=docs, blocks=blocks, sizes=save(index.block_sizes(blocks), "sizes"), tombstones=docs.where("false").select("d"))
        if config.transform == "jlt":
            dim = docs.agg(F.max("c") + 1).first()[0] or 0
            out.jlt = save(projection.matrix(spark, dim, config.jlt_rows, config.jlt_nonzeros, config.seed), "jlt")
        out._summarise(save)
        if config.nknn:
            out.knn = save(out.build_knn(config.nknn), "knn")
        return out

    def _summarise(self, save) -> None:
        c = self.config
        live = updates.compact(self.blocks, self.tombstones)
        cut = {"components": c.summary_components} if c.summary_components else {"energy": c.summary_energy}
        plain = index.summarise(live, self.docs, "max" if c.metric == "max" else "mean", **cut)
        plain = index.dequantise(index.quantise(plain)) if c.quantised else plain
        plain = save(plain, "plain")
        self.radii = save(index.radius(live, plain, self.docs), "radii") if c.metric == "centroid" and self.jlt is None else self.docs.sparkSession.createDataFrame([], "c int, b int, radius double")
        if self.jlt is not None:
            plain = save(projection.transform(plain, self.jlt, ["c", "b"], component="c2").withColumnRenamed("r", "c2"), "summary")
        self.summary = plain

    def save(self, path: str) -> None:
        spark = self.docs.sparkSession
        for name in (*TABLES, *OPTIONAL):
            df = getattr(self, name)
            if df is not None:
                df = df.repartition("c").sortWithinPartitions("c", "b") if name in ("blocks", "summary") else df
                df.write.parquet(f"{path}/{name}")
        spark.createDataFrame([(self.config.to_json(), ",".join(n for n in (*TABLES, *OPTIONAL) if getattr(self, n) is not None))], "config string, tables string").coalesce(1).write.parquet(f"{path}/config")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SparseIndex:
        config, tables = spark.read.parquet(f"{path}/config").first()
        return cls(Config.from_json(config), **{n: spark.read.parquet(f"{path}/{n}") for n in tables.split(",")})

    # looking

    def live(self) -> DataFrame:
        return updates.alive(self.docs, self.tombstones)

    @property
    def dim(self) -> int:
        return self.docs.agg(F.coalesce(F.max("c") + 1, F.lit(0))).first()[0]

    @property
    def nnz(self) -> int:
        return self.docs.count()

    def __len__(self) -> int:
        """All documents, dead ones too."""
        return self.docs.select("d").distinct().count()

    @property
    def is_empty(self) -> bool:
        return not self.docs.limit(1).count()

    @property
    def knn_len(self) -> int:
        return 0 if self.knn is None else self.knn.agg(F.coalesce(F.max("rank"), F.lit(0))).first()[0]

    def get(self, d: int) -> list[tuple[int, float]]:
        rows = self.docs.where(F.col("d") == d).orderBy("c").collect()
        if not rows:
            raise KeyError(d)
        return [(r.c, r.v) for r in rows]

    def vector_len(self, d: int) -> int:
        return len(self.get(d))

    def space(self) -> DataFrame:
        return metrics.corpus_bytes(self.docs, mutable=True)

    # searching

    def search(self, q: DataFrame, params: Search | None = None) -> DataFrame:
        """(q, d, score, rank) for a batch of queries (q, c, v)."""
        s = params or Search()
        asked = None if self.jlt is None else projection.transform(q, self.jlt, ["q"]).withColumnRenamed("r", "c")
        live = self.live()
        found = search.approximate(q, live, updates.compact(self.blocks, self.tombstones), self.sizes, self.summary, s.k, s.cut, s.heap_factor, self.radii if s.alpha > 0 else None, s.alpha, s.by_count, asked)
        return graph.refine(found, q, live, self.knn, s.n_knn, s.k) if s.n_knn and self.knn is not None else found

    batch_search = search

    def search_tokens(self, q: DataFrame, params: Search | None = None) -> DataFrame:
        """Queries (q, token, v) through the index's vocabulary, documents by name; unknown tokens drop out."""
        from sablevec.sources.text import encode_tokens

        found = self.search(encode_tokens(q, "q", self.vocabulary), params)
        if self.names is None:
            return found.withColumn("d", F.col("d").cast("string"))
        return found.join(self.names, "d", "left").select("q", F.coalesce("name", F.col("d").cast("string")).alias("d"), "score", "rank")

    def exact(self, q: DataFrame, k: int = 10) -> DataFrame:
        return search.exact(q, self.live(), k)

    def build_knn(self, degree: int, params: Search | None = None) -> DataFrame:
        """The neighbour graph: documents as queries through the index itself, themselves left out."""
        s = params or Search(k=degree + 1, cut=10, heap_factor=0.7)
        return graph.from_results(self.search(self.docs.withColumnRenamed("d", "q"), s), degree)

    # changing

    def insert(self, new: DataFrame) -> SparseIndex:
        """With new documents (d, c, v), routed to their best blocks."""
        routed = materialise(updates.route(new, self.sizes, self.summary), "routed")
        docs = self.docs.unionByName(new)
        sizes = self.sizes.unionByName(index.block_sizes(routed)).groupBy("c", "b").agg(F.sum("n").alias("n"))
        out = SparseIndex(self.config, **{n: getattr(self, n) for n in (*TABLES, *OPTIONAL)})
        out.docs, out.blocks, out.sizes = docs, self.blocks.unionByName(routed), sizes
        if self.jlt is not None or self.config.metric == "max":
            x = docs if self.jlt is None else projection.transform(docs, self.jlt, ["d"]).withColumnRenamed("r", "c")
            out.summary = updates.insert_max(self.summary, routed, x)
        else:
            out.summary = updates.shift_mean(self.summary, self.sizes, routed, docs, 1)
            out.radii = updates.shift_radius(self.radii, self.summary, self.sizes, routed, docs, 1)
        return out._kept()

    def delete(self, gone: DataFrame) -> SparseIndex:
        """Without documents (d): tombstones at once, touched blocks' summaries and radii follow. Deleting twice is the same as once."""
        fresh = materialise(gone.select("d").distinct().join(self.tombstones, "d", "left_anti").join(self.docs.select("d").distinct(), "d", "left_semi"), "gone")
        out = SparseIndex(self.config, **{n: getattr(self, n) for n in (*TABLES, *OPTIONAL)})
        removed = self.blocks.join(fresh, "d", "left_semi").select("c", "b", "d")
        out.tombstones = self.tombstones.unionByName(fresh)
        live = updates.compact(self.blocks, out.tombstones)
        if self.jlt is None and self.config.metric == "max":
            out.summary = updates.delete_max(self.summary, updates.compact(self.blocks, self.tombstones), self.docs, fresh, self.config.summary_energy)
        elif self.jlt is None:
            out.summary = updates.shift_mean(self.summary, self.sizes, removed, self.docs, -1)
            out.radii = updates.shift_radius(self.radii, self.summary, self.sizes, removed, self.docs, -1)
        out.sizes = index.block_sizes(live)
        return out._kept()

    def resize(self) -> SparseIndex:
        """Compacted: dead postings and documents leave, summaries and radii are made anew."""
        out = SparseIndex(self.config, **{n: getattr(self, n) for n in (*TABLES, *OPTIONAL)})
        out.docs, out.blocks = materialise(self.live(), "docs"), materialise(updates.compact(self.blocks, self.tombstones), "blocks")
        out.tombstones = out.docs.where("false").select("d")
        out.sizes = materialise(index.block_sizes(out.blocks), "sizes")
        out._summarise(materialise)
        return out

    def _kept(self) -> SparseIndex:
        for name in TABLES:
            setattr(self, name, materialise(getattr(self, name), name))
        return self


def build_from_tokens(tokens: DataFrame, config: Config | None = None, vocabulary: DataFrame | None = None) -> SparseIndex:
    """An index of named documents (name, token, v), with its vocabulary and names."""
    from sablevec.plans.search_queries import vocabulary as first_seen
    from sablevec.sources.text import encode_tokens, number_documents

    names = materialise(number_documents(tokens), "names")
    numbered = tokens.join(names, "name").select("d", "token", "v")
    known = vocabulary if vocabulary is not None else materialise(first_seen(numbered), "vocabulary")
    out = SparseIndex.build(encode_tokens(numbered, "d", known), config)
    out.vocabulary, out.names = known, names
    return out
