"""Queries over the supplied tables, each with the SQL that checks it.

Models and tokenizer are the stand-ins described with their operators. Sizes are small enough that all cases occur at the scale of the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.functions.tokens import BOS, EOS, SQL_TOKEN_TABLE, SQL_WORD, VOCABULARY, chunks, n_tokens, tokenize_by_words, with_bos
from siftwork.operators import bytepairs, heads, ngrams, packing, probes, ranking, scoring, sentences, streams
from siftwork.session import table
from siftwork.sources import arriving, shards, tables
from siftwork.sources.storage import scratch
from siftwork.streaming import documents as arrived

#: Tokens in a shard of the layout queries, in one of the pointer queries (so that documents span three and more), and in a chunk.
SHARD, SMALL_SHARD, CHUNK = 20_000, 512, 512
BLOCK = 128
#: Tokens in the shards of unequal sizes, again and again.
SIZES = (20_000, 3_000, 7, 50_001, 511)
#: Shards that are taken in at a time.
ARRIVALS = 64
#: What the filtered scan asks for: shards from this one on, places below this one, blocks.
FROM, BELOW, BLOCKS = "part_000003", 40_000, (0, 3, 4, 150, 155)
MAX_TOKENS = 100_000
TOP = 20.0
#: Probes: how many, their token budget, seed.
N_PROBES, BUDGET, SEED = 800, 4_096, "probes"
#: Attention: vectors in a sequence, of them in the prompt, heads, per cent of heads chosen, layers that heads are counted in.
SEQUENCE, PROMPT, HEADS, HEADS_PER_LAYER, TOP_HEADS = 50, 40, 16, 8, 20.0
HEAD_DIM = 4
#: Places that are read of every shard by the range scan, both included.
RANGE = (100, 299)
DOCS = ("lang", "source")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", *DOCS)


def _dealt_out(docs: DataFrame) -> DataFrame:
    """A table in fewer pieces than there are cores goes to all of them."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs if docs.rdd.getNumPartitions() >= cores else docs.repartition(cores)


def doc_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", n_tokens(F.col("text")).alias("n_text_tokens"), (n_tokens(F.col("text")) + 1).alias("n_tokens"))


def _tokenizer() -> str:
    """Path of a byte-level tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_pair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids by a real vocabulary, which SQL can't merge; test_bytepairs compares them with those of its own library."""
    made = bytepairs.encode(_documents(spark, sf_dir), _tokenizer())
    return made.select("doc_id", "n_tokens", F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))


def byte_pair_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts back from these ids."""
    back = bytepairs.decode(bytepairs.encode(_documents(spark, sf_dir), _tokenizer()), _tokenizer())
    return back.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


def token_prefix_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.positions(_documents(spark, sf_dir)).select("doc_id", "n_tokens", "total_tokens_seen")


def shard_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.layout(packing.positions(_documents(spark, sf_dir)).checkpoint(), SHARD)


def shard_doc_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = packing.positions(_documents(spark, sf_dir))
    return placed.select("doc_id", packing.pointer(packing.ranges(SMALL_SHARD)).alias("pointer"), "total_tokens_seen")


def _stream(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Tokens of the documents with their totals, and the pieces of the shards that they fill."""
    docs = _documents(spark, sf_dir)
    made = packing.token_table(docs).checkpoint()
    tokens = made.join(packing.placed(made), "doc_id").checkpoint()
    return tokens, packing.slices(tokens, SMALL_SHARD, BLOCK)


def doc_split_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.islands(_stream(spark, sf_dir)[1], SMALL_SHARD)


def _digest(tokens: DataFrame) -> DataFrame:
    return tokens.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))


def doc_id_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens, pieces = _stream(spark, sf_dir)
    pointers = tokens.select("doc_id", packing.pointer(packing.ranges(SMALL_SHARD)).alias("pointer"))
    return _digest(packing.resolve(pointers, pieces.withColumn("shard_name", packing.shard_name(F.col("shard"))), BLOCK))


def shard_file_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards written by the data source, read by Spark's own file reader, split at their ends again."""
    pieces = _stream(spark, sf_dir)[1]
    path = scratch(spark, "shards")
    shards.write(pieces.withColumn("shard", packing.shard_name(F.col("shard"))), path)
    number = F.regexp_extract("shard", "(\\d+)$", 1).cast("long")
    back = shards.read_with_spark(spark, f"{path}/*.bin", BLOCK).withColumn("shard", number)
    return packing.islands(back, SMALL_SHARD)


def _scanned(spark: SparkSession, sf_dir: str, lo: int | None = None, hi: int | None = None) -> DataFrame:
    path = scratch(spark, "shards")
    shards.write(_stream(spark, sf_dir)[1].withColumn("shard", packing.shard_name(F.col("shard"))), path)
    read = shards.read(spark, f"{path}/*.bin", lo, hi, BLOCK)
    total = F.aggregate("tokens", F.lit(0).cast("long"), lambda s, t: s + t)
    return read.groupBy("shard").agg(F.sum(F.size("tokens")).cast("long").alias("n_tokens"), F.sum(total).alias("token_sum"), F.min("at").alias("first"))


def shard_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards written and read by the data source."""
    return _scanned(spark, sf_dir)


def shard_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for a range of places in every shard."""
    return _scanned(spark, sf_dir, *RANGE)


def _uneven(spark: SparkSession, sf_dir: str) -> str:
    """Path of files of the documents' tokens in shards of SIZES."""
    made = packing.token_table(_documents(spark, sf_dir)).checkpoint()
    tokens = made.join(packing.placed(made), "doc_id").checkpoint()
    total = F.lit(tokens.agg(F.max("total_tokens_seen")).first()[0] or 0)
    # A row for each shard, all of it arithmetic.
    turn, before = sum(SIZES), [sum(SIZES[:i]) for i in range(len(SIZES))]
    shard = spark.range(1).select(F.explode(F.sequence(F.lit(0), F.floor(total / turn))).alias("k")).select("k", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(n).cast("long").alias("size"), F.lit(b).cast("long").alias("b")) for i, (n, b) in enumerate(zip(SIZES, before, strict=True))))).alias("x"))
    start = F.col("k") * turn + F.col("x.b")
    known = shard.select(F.concat(F.lit("part_"), F.lpad((F.col("k") * len(SIZES) + F.col("x.i")).cast("string"), 6, "0")).alias("shard"), start.alias("start"), F.least("x.size", total - start).alias("n")).where("n > 0").checkpoint()
    path = scratch(spark, "shards")
    shards.write(streams.slices(tokens, known, BLOCK), path)
    return f"{path}/*.bin"


def _pointed(tokens: DataFrame) -> DataFrame:
    return tokens.select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens"), "total_tokens_seen", F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))


def shard_any_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of unequal sizes, written and read by the data source, split at the ends of documents; ids are pointers."""
    return _pointed(streams.split(*streams.read(spark, _uneven(spark, sf_dir), block=BLOCK), block=BLOCK))


def shard_early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents up to MAX_TOKENS of the same shards, from the shards that hold them."""
    return _pointed(scoring.until(streams.split(*streams.read(spark, _uneven(spark, sf_dir), max_tokens=MAX_TOKENS, block=BLOCK), block=BLOCK), MAX_TOKENS))


def shard_filtered_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the same shards by filters that the data source turns into files and bytes."""
    rows = shards.read(spark, _uneven(spark, sf_dir), block=BLOCK).where((F.col("shard") >= FROM) & (F.col("at") < BELOW) & F.col("block").isin(*BLOCKS))
    return rows.select("shard", "block", "at", F.size("tokens").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))


def shard_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the same shards by the queries for shards that arrive, some at a time."""
    path = _uneven(spark, sf_dir)
    folder, out, state = path.removesuffix("/*.bin"), scratch(spark, "arrived"), scratch(spark, "stream")
    arrived.run(spark, folder, out, state, most=ARRIVALS)
    arriving.finish(folder, shards.headers(spark, path).count())
    arrived.run(spark, folder, out, state)
    return arrived.read(spark, out).select("doc_id", "n_tokens", F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))


def probe_file_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "probes")
    tables.write_probes(probe_prompt(spark, sf_dir).withColumnRenamed("probe_id", "id"), path)
    return tables.read_probes(spark, path)


def score_file_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores written as text and as Parquet; the text is read."""
    path, micro = scratch(spark, "scores"), F.lit(float(scoring.MICRO))
    made = _scores(spark, sf_dir)
    tables.write_scores(made.select(F.col("doc_id").cast("string"), (F.col("l_base") / micro).alias("L_base"), (F.col("l_ref") / micro).alias("L_ref"), F.col("ai_score").alias("AI_Score"), "total_tokens_seen"), path)
    return tables.read_scores(spark, f"{path}/tsv")


def selection_file_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "selection")
    tables.write_selection(rank_top20(spark, sf_dir).select(F.col("doc_id").cast("string"), F.col("ai_score").alias("AI_Score"), "tok_len"), path)
    return tables.read_selection(spark, f"{path}/tsv")


def head_list_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "heads")
    tables.write_heads(retrieval_heads_topk(spark, sf_dir), path)
    return tables.read_heads(spark, path)


def masked_weights_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked weights as a file that is read again, summed up."""
    path = scratch(spark, "weights")
    tables.write_weights(_masked(spark, sf_dir), path)
    return _row_sums(tables.read_weights(spark, path)).select("layer", "proj", "row_idx", "w_sum")


def chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = packing.token_table(_documents(spark, sf_dir))
    each = tokens.select("doc_id", F.posexplode(chunks(F.col("tokens"), CHUNK)).alias("chunk", "t"))
    return each.select("doc_id", "chunk", (F.col("chunk") * CHUNK).cast("long").alias("start"), (F.size("t") - 1).cast("long").alias("n_targets"), F.size(with_bos(F.col("t"))).cast("long").alias("n_input"))


def _scores(spark: SparkSession, sf_dir: str, max_tokens: int | None = None) -> DataFrame:
    """doc_id, lang, source, l_base, l_ref, ai_score, n_tokens, total_tokens_seen."""
    docs = _documents(spark, sf_dir)
    tokens = packing.token_table(docs, *DOCS).checkpoint()
    placed = scoring.until(tokens.select("doc_id", "n_tokens").join(packing.placed(tokens), "doc_id"), max_tokens)
    read = tokens if max_tokens is None else tokens.join(placed.select("doc_id"), "doc_id", "left_semi")
    share = scoring.frequencies(tokens)
    scored = scoring.ai_score(scoring.score(read, scoring.stand_in(share), CHUNK, DOCS))
    return scored.join(placed, "doc_id")


SCORE_COLUMNS = ("doc_id", "l_base", "l_ref", "ai_score", "total_tokens_seen")


def ai_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).select(*SCORE_COLUMNS)


def ai_scores_max_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir, MAX_TOKENS).select(*SCORE_COLUMNS)


def trigram_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses of chunks under a smoothed trigram model that is fitted to all documents."""
    tokens = _dealt_out(_documents(spark, sf_dir)).select("doc_id", tokenize_by_words("text").alias("tokens"))
    model = ngrams.fit(tokens, CHUNK)
    try:
        return ngrams.chunk_losses(tokens, model, CHUNK)
    finally:
        model.clear()


def trigram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much documents lose when that model loses its context."""
    tokens = _dealt_out(_documents(spark, sf_dir)).select("doc_id", tokenize_by_words("text").alias("tokens"))
    model = ngrams.fit(tokens, CHUNK)
    try:
        return scoring.ai_score(ngrams.document_losses(tokens, model, CHUNK))
    finally:
        model.clear()


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score table as a program finds it on disk: lengths come from differences again."""
    return ranking.lengths(_scores(spark, sf_dir).drop("n_tokens", "l_base", "l_ref")).checkpoint()


RANKED = ("doc_id", "ai_score", "tok_len")


def rank_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.select(_ranked(spark, sf_dir), TOP).select(*RANKED)


def rank_bottom20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.select(_ranked(spark, sf_dir), bottom=TOP).select(*RANKED)


def rank_top20_per_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.select(_ranked(spark, sf_dir), TOP, by="lang").select("lang", *RANKED)


def selection_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _ranked(spark, sf_dir)
    return ranking.summary(ranking.select(scores, TOP), scores)


def score_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and their summed losses by label."""
    labelled = _scores(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")
    return labelled.groupBy("quality", "toxic").agg(F.count("*").alias("n_docs"), F.sum("l_base").alias("l_base"), F.sum("l_ref").alias("l_ref"), F.count_if(F.col("ai_score") > 0).alias("n_positive"))


def sentence_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probes.pool(_documents(spark, sf_dir))


def abbreviation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that are seen with a period, by language, and how much speaks for their being abbreviations."""
    return sentences.abbreviations(sentences.counted(_documents(spark, sf_dir))).withColumnRenamed("by", "lang")


def sentences_by_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of all documents by that; test_sentences has a labelled set."""
    docs = _documents(spark, sf_dir)
    return sentences.split(docs, sentences.fit(docs))


def probe_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probes.contexts(probes.pool(_documents(spark, sf_dir)), N_PROBES, SEED)


def probe_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probes.prompts(probe_context(spark, sf_dir), BUDGET, SEED)


def head_copy_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = heads.sequences(table(spark, sf_dir, "embeddings"), SEQUENCE)
    return heads.copy_recall(seq, heads.attention(seq, PROMPT, HEADS), PROMPT)


def retrieval_heads_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heads.best_heads(head_copy_recall(spark, sf_dir), HEADS_PER_LAYER, TOP_HEADS)


def _masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors stand for weight rows: 32 to a projection, three projections to a layer."""
    rows = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 96").cast("int").alias("layer"), F.element_at(F.array(F.lit("q"), F.lit("k"), F.lit("v")), F.expr("cast(vec_id div 32 % 3 as int) + 1")).alias("proj"), F.expr("cast(vec_id % 32 as int)").alias("row_idx"), F.col("embedding").cast("array<double>").alias("w"))
    chosen = retrieval_heads_topk(spark, sf_dir).select("layer", F.col("head_in_layer").alias("head"))
    return heads.masked(rows, chosen, HEAD_DIM, HEADS_PER_LAYER)


def _row_sums(weights: DataFrame) -> DataFrame:
    return weights.withColumn("w_sum", F.round(F.aggregate("w", F.lit(0.0), lambda a, x: a + x), 6))


def masked_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _row_sums(_masked(spark, sf_dir)).select("layer", "proj", "row_idx", "masked", "w_sum")


def mixture_70_30(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training mixture: the selected documents, and of the others as many as make them 70 per cent of the expected rows, by a seeded hash."""
    scores = _ranked(spark, sf_dir)
    chosen = ranking.select(scores, TOP).select("doc_id", F.lit("selected").alias("part"))
    k = ranking.how_many(scores.count(), TOP)
    rest = scores.join(chosen, "doc_id", "left_anti")
    share = k * 30.0 / 70.0 / max(1, scores.count() - k)
    drawn = rest.where(probes.number(probes.hashed("mixture", F.col("doc_id").cast("string"))) < int(share * (1 << 48))).select("doc_id", F.lit("random").alias("part"))
    return chosen.unionByName(drawn)


QUERIES = {
    f.__name__: f
    for f in (
        doc_token_counts, byte_pair_tokens, byte_pair_text, token_prefix_sum, shard_layout, shard_doc_ids, doc_split_islands, doc_id_resolve, shard_file_roundtrip, chunk_table, ai_scores, ai_scores_max_tokens, trigram_losses, trigram_scores, rank_top20, rank_bottom20,
        rank_top20_per_domain, selection_summary, score_by_label, sentence_pool, abbreviation_scores, sentences_by_statistics, probe_context, probe_prompt, head_copy_recall, retrieval_heads_topk, masked_weights, mixture_70_30,
        shard_scan, shard_range_scan, shard_any_size, shard_early_stop, shard_filtered_scan, shard_arrivals, probe_file_roundtrip, score_file_roundtrip, selection_file_roundtrip, head_list_roundtrip, masked_weights_roundtrip,
    )
}


def _name(i: str) -> str:
    return f"'{packing.PREFIX}_' || case when {i} = 0 then 'val' else 'train' end || '_' || lpad(cast({i} as varchar), 6, '0')"


def _quoted(text: str) -> str:
    return text.replace("'", "''")


_T = SQL_TOKEN_TABLE
_PARTS = f"""parts as (select doc_id, total_tokens_seen, unnest(range((total_tokens_seen - n_tokens) // {SMALL_SHARD}, (total_tokens_seen - 1) // {SMALL_SHARD} + 1)) as s, n_tokens from seen)"""
_SCORED = f"""
    exploded as (select doc_id, unnest(tokens) as token, generate_subscripts(tokens, 1) - 1 as pos from docs),
    unigram as (select token, count(*) / cast((select count(*) from exploded) as double) as p from exploded group by token),
    inputs as (select doc_id, pos // {CHUNK} as chunk, pos, token, true as target from exploded where pos > 0 and pos % {CHUNK} <> 0
        union all select doc_id, pos // {CHUNK} - 1, pos, token, true from exploded where pos > 0 and pos % {CHUNK} = 0
        union all select doc_id, pos // {CHUNK}, pos, token, false from exploded e where pos % {CHUNK} = 0 and pos < (select n_tokens - 1 from counted c where c.doc_id = e.doc_id)),
    ordered as (select *, row_number() over (partition by doc_id, chunk order by pos) as before, row_number() over (partition by doc_id, chunk, token order by pos) - 1 as same from inputs),
    loss as (select doc_id, cast(floor(-ln(0.5::double * (same / cast(before as double)) + 0.5::double * p) * 1000000 + 0.5) as bigint) as b, cast(floor(-ln(p) * 1000000 + 0.5) as bigint) as r
        from ordered join unigram using (token) where target),
    per_doc as (select doc_id, cast(sum(b) as bigint) as l_base, cast(sum(r) as bigint) as l_ref from loss group by doc_id),
    scores as (select doc_id, lang, source, n_tokens, total_tokens_seen, coalesce(l_base, 0) as l_base, coalesce(l_ref, 0) as l_ref,
        round((coalesce(l_ref, 0) / 1e6::double - coalesce(l_base, 0) / 1e6::double) / greatest(coalesce(l_base, 0) / 1e6::double, 1e-12::double), 6) as ai_score from seen left join per_doc using (doc_id))"""
_S = f"{_T}, {_SCORED}"
_TOP = f"ceil((select count(*) from scores) * {TOP}::double / 100)"
_TOP_ROWS = f"select *, n_tokens as tok_len from scores qualify row_number() over (order by ai_score desc, total_tokens_seen) <= {_TOP}"
_SENTENCES = f"""
    cut as (select doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?])[ \\t\\n\\r]+', '\\1' || chr(30), 'g'), chr(30)) as parts from documents),
    each as (select doc_id, unnest(parts) as raw, generate_subscripts(parts, 1) - 1 as sent_no from cut),
    trimmed as (select doc_id, cast(sent_no as integer) as sent_no, regexp_replace(raw, '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g') as sentence from each),
    pool as (select *, cast(len(regexp_extract_all(sentence, '{SQL_WORD}')) as bigint) as n_tok from trimmed where len(regexp_extract_all(sentence, '{SQL_WORD}')) between {probes.LEAST} and {probes.MOST})"""


def _shuffled() -> str:
    """The permutation of probes.shuffled as one expression, with {{i}} for the place."""
    row, column = "({i} // b)", "({i} % b)"
    for step in range(probes.STEPS):
        row = f"(({row} + ('0x' || substr(md5('{SEED}:draw:' || probe_id || ':{step}a:' || {column}), 1, 12))::bigint % a) % a)"
        column = f"(({column} + ('0x' || substr(md5('{SEED}:draw:' || probe_id || ':{step}b:' || {row}), 1, 12))::bigint % b) % b)"
    return f"({row} * b + {column})"


_SHUFFLED = _shuffled()
_CONTEXT = f"""{_SENTENCES},
    known as (select *, row_number() over (order by doc_id, sent_no) - 1 as sent_id from pool),
size as (select n, cast(ceil(sqrt(n::double)) as bigint) as a, cast(ceil(n::double / ceil(sqrt(n::double))) as bigint) as b from (select count(*) as n from known)),
    walks(probe_id, i, number, n, a, b) as (select p.probe_id, i.i, {_SHUFFLED.format(i="i.i")}, n, a, b from size, range({N_PROBES}) p(probe_id), range({probes.SIZES[0]}) i(i) where i.i < n
        union all select probe_id, i, {_SHUFFLED.format(i="number")}, n, a, b from walks where number >= n),
    firsts as (select probe_id, number as sent_id, i as pos from walks where number < n),
    context as (select cast(probe_id as integer) as probe_id, cast(pos as integer) as pos, md5('{SEED}:key:' || probe_id || ':' || pos) as key, sentence from firsts join known using (sent_id) where pos < {probes.SIZES[0]})"""
_ATTENTION = f"""
    seq as (select vec_id // {SEQUENCE} as probe_id, vec_id % {SEQUENCE} as pos, label as token, embedding as v from embeddings),
    can as (select * from seq a where pos >= {PROMPT} and exists (select 1 from seq b where b.probe_id = a.probe_id and b.pos < {PROMPT} and b.token = a.token)),
    sims as (select h.head, a.probe_id, a.pos, a.token, b.pos as spot, b.token as other,
        a.v[4 * h.head + 1]::double * b.v[4 * h.head + 1] + a.v[4 * h.head + 2]::double * b.v[4 * h.head + 2] + a.v[4 * h.head + 3]::double * b.v[4 * h.head + 3] + a.v[4 * h.head + 4]::double * b.v[4 * h.head + 4] as s
        from can a join seq b on a.probe_id = b.probe_id and b.pos < {PROMPT} cross join range({HEADS}) h(head)),
    picked as (select * from sims qualify row_number() over (partition by head, probe_id, pos order by s desc, spot) = 1),
    recall as (select cast(head as integer) as head, count(*) filter (where token = other) as hits, count(*) as attempts, round(count(*) filter (where token = other) / (count(*) + 1e-12::double), 6) as recall from picked group by head),
    best as (select row_number() over (order by recall desc, head) as rank, head, recall from recall),
    heads as (select cast(rank as integer) as rank, cast(head // {HEADS_PER_LAYER} as integer) as layer, cast(head % {HEADS_PER_LAYER} as integer) as head_in_layer, recall from best where rank <= ceil((select count(*) from recall) * {TOP_HEADS}::double / 100))"""

ORACLES = {
    "doc_token_counts": f"with {_T} select doc_id, cast(n_tokens - 1 as bigint) as n_text_tokens, cast(n_tokens as bigint) as n_tokens from counted",
    "token_prefix_sum": f"with {_T} select doc_id, cast(n_tokens as bigint) as n_tokens, total_tokens_seen from seen",
    "shard_layout": f"""with {_T}, total as (select max(total_tokens_seen) as t from seen), s as (select unnest(range(0, (t - 1) // {SHARD} + 1)) as shard_index, t from total),
        d as (select (total_tokens_seen - n_tokens) // {SHARD} as shard_index, count(*) as n from seen group by 1)
        select shard_index, {_name("shard_index")} as shard_name, cast(least({SHARD}, t - shard_index * {SHARD}) as bigint) as n_tokens, coalesce(n, 0) as n_docs_started from s left join d using (shard_index)""",
    "shard_doc_ids": f"""with {_T}, {_PARTS} select doc_id, string_agg({_name("s")} || ':' || greatest(total_tokens_seen - n_tokens - s * {SMALL_SHARD}, 0) || '-' || least(total_tokens_seen - 1 - s * {SMALL_SHARD}, {SMALL_SHARD} - 1), '{packing.DASH}' order by s) as pointer, total_tokens_seen from parts group by doc_id, total_tokens_seen""",
    "doc_split_islands": f"""with {_T}, stream as (select token, row_number() over (order by doc_id, pos) - 1 as g from (select doc_id, unnest(tokens) as token, generate_subscripts(tokens, 1) as pos from docs)),
        marked as (select g, coalesce(sum(case when token = {EOS} then 1 else 0 end) over (order by g rows between unbounded preceding and 1 preceding), 0) as island from stream)
        select min(g) as doc_start, max(g) as doc_end, count(*) as n_tokens, max(g) + 1 as total_tokens_seen from marked group by island""",
    "doc_id_resolve": f"with {_T} select doc_id, cast(n_tokens as bigint) as n_tokens, md5(array_to_string(tokens, ' ')) as tokens_md5 from counted",
    "chunk_table": f"""with {_T}, c as (select doc_id, n_tokens, unnest(range(0, n_tokens - 1, {CHUNK})) as start from counted where n_tokens >= 2)
        select doc_id, cast(start // {CHUNK} as integer) as chunk, start, cast(least({CHUNK}, n_tokens - 1 - start) as bigint) as n_targets, cast(least({CHUNK}, n_tokens - 1 - start) + 2 as bigint) as n_input from c""",
    "ai_scores": f"with {_S} select doc_id, l_base, l_ref, ai_score, total_tokens_seen from scores",
    "ai_scores_max_tokens": f"with {_S} select doc_id, l_base, l_ref, ai_score, total_tokens_seen from scores where total_tokens_seen - n_tokens < {MAX_TOKENS} or total_tokens_seen = n_tokens",
    "rank_top20": f"with {_S} select doc_id, ai_score, cast(tok_len as bigint) as tok_len from ({_TOP_ROWS})",
    "rank_bottom20": f"with {_S} select doc_id, ai_score, cast(n_tokens as bigint) as tok_len from scores qualify row_number() over (order by ai_score, total_tokens_seen) <= {_TOP}",
    "rank_top20_per_domain": f"with {_S} select lang, doc_id, ai_score, cast(n_tokens as bigint) as tok_len from scores qualify row_number() over (partition by lang order by ai_score desc, total_tokens_seen) <= ceil(count(*) over (partition by lang) * {TOP}::double / 100)",
    "selection_summary": f"with {_S} select count(*) as n_selected, cast(coalesce(sum(tok_len), 0) as bigint) as selected_tokens, (select max(total_tokens_seen) from scores) as total_tokens, round(sum(tok_len) * 100.0::double / (select max(total_tokens_seen) from scores), 6) as token_pct from ({_TOP_ROWS})",
    "score_by_label": f"with {_S} select quality, toxic, count(*) as n_docs, cast(sum(l_base) as bigint) as l_base, cast(sum(l_ref) as bigint) as l_ref, count(*) filter (where ai_score > 0) as n_positive from scores join labels using (doc_id) group by quality, toxic",
    "sentence_pool": f"with {_SENTENCES} select doc_id, sent_no, sentence, n_tok from pool",
    "probe_context": f"with recursive {_CONTEXT} select probe_id, pos, key, sentence from context",
    "probe_prompt": f"""with recursive {_CONTEXT},
        tried as (select c.*, k.k, row_number() over (partition by c.probe_id, k.k order by md5('{SEED}:ask:' || c.probe_id || ':' || k.k || ':' || c.pos)) as ask from context c, (values {", ".join(f"({k})" for k in probes.SIZES)}) k(k) where c.pos < k.k),
        made as (select probe_id, k, '{probes.INSTRUCTION.rstrip(chr(10))}' || chr(10) || '{{' || string_agg(cast(to_json(key) as varchar) || ': ' || cast(to_json(sentence) as varchar), ', ' order by pos) || '}}' || chr(10) || chr(10)
            || string_agg(key || chr(10) || sentence || chr(10), '' order by ask) filter (where ask <= 3) || max(key) filter (where ask = 4) || chr(10) || 'answer:' as prompt, max(sentence) filter (where ask = 4) as answer
            from tried group by probe_id, k having count(*) = k)
        select probe_id, cast(k as integer) as k, prompt, answer from made where len(regexp_extract_all(prompt, '{SQL_WORD}')) + 1 <= {BUDGET} qualify row_number() over (partition by probe_id order by k desc) = 1""",
    "head_copy_recall": f"with {_ATTENTION} select head, hits, attempts, recall from recall",
    "retrieval_heads_topk": f"with {_ATTENTION} select rank, layer, head_in_layer, recall from heads",
    "masked_weights": f"""with {_ATTENTION}, rows_ as (select cast(vec_id // 96 as integer) as layer, ['q', 'k', 'v'][(vec_id // 32) % 3 + 1] as proj, cast(vec_id % 32 as integer) as row_idx, embedding as w from embeddings)
        select r.layer, proj, row_idx, h.layer is not null as masked, case when h.layer is null then round(list_reduce(list_transform(w, lambda x: x::double), lambda a, x: a + x), 6) else 0.0::double end as w_sum
        from rows_ r left join heads h on h.layer = r.layer and h.head_in_layer = row_idx // {HEAD_DIM}""",
    "mixture_70_30": f"""with {_S}, top as ({_TOP_ROWS}), n as (select count(*) as n, {_TOP} as k from scores)
        select doc_id, 'selected' as part from top union all select doc_id, 'random' from scores, n where doc_id not in (select doc_id from top)
        and ('0x' || substr(md5('mixture:' || doc_id), 1, 12))::bigint < floor(k * 30.0::double / 70.0::double / greatest(1, n - k) * 281474976710656)""",
}
ORACLES["shard_file_roundtrip"] = ORACLES["doc_split_islands"]
_STREAM = f"""stream as (select token, row_number() over (order by doc_id, pos) - 1 as g from (select doc_id, unnest(tokens) as token, generate_subscripts(tokens, 1) as pos from docs)),
    placed as (select token, g // {SMALL_SHARD} as s, g % {SMALL_SHARD} as spot from stream)"""
_SCAN = f"select {_name('s')} as shard, count(*) as n_tokens, cast(sum(token) as bigint) as token_sum, cast(min(spot) as bigint) as first from placed"
_TRIGRAMS = f"""
    padded as (select doc_id, list_prepend({BOS}, tokens) as x, n_tokens as n from counted),
    every as materialized (select doc_id, (i - 1) // {CHUNK} as chunk, case when (i - 1) % {CHUNK} = 0 then {BOS} else x[i] end as u, x[i] as before, x[i + 1] as v, x[i + 2] as w from (select doc_id, x, unnest(range(1, n)) as i from padded)),
    tri as materialized (select before as u, v, w, count(*) as c from every group by all),
    ctx as (select u, v, sum(c) as c_uv, count(*) as n_uv from tri group by all),
    bi as materialized (select v, w, count(*) as k from tri group by all),
    firsts as (select v, sum(k) as k_v, count(*) as n_v from bi group by all),
    singles as (select w, count(*) as m from bi group by all),
    d as (select coalesce(t1 / nullif(t1 + 2 * t2, 0)::double, 0.5) as d3, coalesce(b1 / nullif(b1 + 2 * b2, 0)::double, 0.5) as d2, coalesce(s1 / nullif(s1 + 2 * s2, 0)::double, 0.5) as d1, total, types
        from (select count(*) filter (where c = 1) as t1, count(*) filter (where c = 2) as t2 from tri), (select count(*) filter (where k = 1) as b1, count(*) filter (where k = 2) as b2 from bi),
            (select count(*) filter (where m = 1) as s1, count(*) filter (where m = 2) as s2, sum(m) as total, count(*) as types from singles)),
    p1 as (select w, (greatest(m - d1, 0) + d1 * types * (1.0::double / {VOCABULARY})) / total as p1 from singles, d),
    asked as (select distinct u, v, w from every),
    p2 as (select a.*, p1, case when k_v is null then p1 else (greatest(coalesce(k, 0) - d2, 0) + d2 * n_v * p1) / k_v end as p2 from asked a join p1 using (w) left join bi using (v, w) left join firsts using (v), d),
    p3 as (select p2.*, case when c_uv is null then p2 else (greatest(coalesce(c, 0) - d3, 0) + d3 * n_uv * p2) / c_uv end as p3 from p2 left join tri using (u, v, w) left join ctx using (u, v), d),
    chunk_losses as materialized (select doc_id, cast(chunk as integer) as chunk, count(*) as n_targets, {", ".join(f"cast(sum(cast(floor(-ln({p}) * 1000000 + 0.5) as bigint)) as bigint) as {name}" for p, name in (("p3", "l_trigram"), ("p2", "l_bigram"), ("p1", "l_unigram")))}
        from every join p3 using (u, v, w) group by doc_id, chunk)"""
_UNEVEN = f"""sizes as (select unnest([{", ".join(map(str, SIZES))}]) as size, unnest(range({len(SIZES)})) as i),
    turns as (select k * {len(SIZES)} + i as number, k * {sum(SIZES)} + sum(size) over (partition by k order by i) - size as start, size, total from sizes, (select max(total_tokens_seen) as total from seen), range(total // {sum(SIZES)} + 1) k(k)),
    spans as (select 'part_' || lpad(cast(number as varchar), 6, '0') as shard, cast(start as bigint) as start, cast(least(size, total - start) as bigint) as n from turns where start < total)"""
_POINTED = f"""select string_agg(shard || ':' || greatest(total_tokens_seen - n_tokens - start, 0) || '-' || least(total_tokens_seen - start, n) - 1, '{packing.DASH}' order by start) as doc_id,
    cast(any_value(n_tokens) as bigint) as n_tokens, total_tokens_seen, any_value(md5(array_to_string(tokens, ' '))) as tokens_md5 from seen join spans on start < total_tokens_seen and start + n > total_tokens_seen - n_tokens"""
ORACLES |= {
    "abbreviation_scores": f"""with w as (select lang, unnest(regexp_extract_all(coalesce(text, ''), '{SQL_WORD}')) as word from documents),
        t as (select lang, regexp_replace(lower(regexp_replace(word, '^{_quoted(sentences.OPENERS)}+|{_quoted(sentences.CLOSERS)}+$', '', 'g')), '^[0-9]+(?:[.,:][0-9]+)*(\\.?)$', '{sentences.NUMBER}\\1') as type from w),
        c as (select lang, case when regexp_matches(type, '[^.]\\.$') then type[:-2] else type end as base, regexp_matches(type, '[^.]\\.$') as stop from t),
        n as (select lang, base, count(*) filter (where stop) as n_with, count(*) as n from c group by all),
        e as (select lang, sum(n) as words, sum(n_with) as stops from n group by lang),
        s as (select n.*, length(replace(base, '.', '')) as size, n - n_with as without, stops / words::double as p from n join e on n.lang is not distinct from e.lang where n_with > 0 and regexp_matches(base, '\\p{{L}}'))
        select lang, base, n_with, n, round(2 * (n_with * ln({sentences.CERTAIN}::double / p) + case when without > 0 then without * ln((1 - {sentences.CERTAIN}::double) / (1 - p)) else 0 end) * exp(-size::double) * (length(base) - size + 1) * pow(size::double, -without::double), 6) + 0 as score,
            score >= {sentences.ABBREVIATION}::double as abbreviation from s""",
    "byte_pair_text": "select doc_id, length(coalesce(text, '')) as n_chars, md5(coalesce(text, '')) as text_md5 from documents",
    "trigram_losses": f"with {_T}, {_TRIGRAMS} select * from chunk_losses",
    "trigram_scores": f"""with {_T}, {_TRIGRAMS}, per_doc as (select doc_id, cast(coalesce(sum(l_trigram), 0) as bigint) as l_base, cast(coalesce(sum(l_unigram), 0) as bigint) as l_ref from counted left join chunk_losses using (doc_id) group by doc_id)
        select *, round((l_ref / 1e6::double - l_base / 1e6::double) / greatest(l_base / 1e6::double, 1e-12::double), 6) as ai_score from per_doc""",
    "shard_any_size": f"with {_T}, {_UNEVEN} {_POINTED} group by total_tokens_seen",
    "shard_arrivals": f"with {_T}, {_UNEVEN} select doc_id, n_tokens, tokens_md5 from ({_POINTED} group by total_tokens_seen)",
    "shard_early_stop": f"with {_T}, {_UNEVEN} {_POINTED} where total_tokens_seen - n_tokens < {MAX_TOKENS} or total_tokens_seen = n_tokens group by total_tokens_seen",
    "shard_filtered_scan": f"""with {_T}, {_UNEVEN}, stream as (select token, row_number() over (order by doc_id, pos) - 1 as g from (select doc_id, unnest(tokens) as token, generate_subscripts(tokens, 1) as pos from docs)),
        placed as (select shard, token, g - start as spot from stream join spans on g >= start and g < start + n)
        select shard, spot // {BLOCK} as block, min(spot) as at, cast(count(*) as integer) as n_tokens, md5(string_agg(token, ' ' order by spot)) as tokens_md5 from placed where shard >= '{FROM}' and spot // {BLOCK} in {BLOCKS} group by shard, spot // {BLOCK} having min(spot) < {BELOW}""",
    "shard_scan": f"with {_T}, {_STREAM} {_SCAN} group by s",
    "shard_range_scan": f"with {_T}, {_STREAM} {_SCAN} where spot between {RANGE[0]} and {RANGE[1]} group by s",
    "probe_file_roundtrip": f"select probe_id as id, prompt, answer from ({ORACLES['probe_prompt']})",
    # Whole millionths to four places, half up.
    "score_file_roundtrip": f"with {_S} select cast(doc_id as varchar) as doc_id, ((l_base + 50) // 100) / 10000::double as \"L_base\", ((l_ref + 50) // 100) / 10000::double as \"L_ref\", ai_score as \"AI_Score\", total_tokens_seen from scores",
    "selection_file_roundtrip": f"select cast(doc_id as varchar) as doc_id, ai_score as \"AI_Score\", tok_len from ({ORACLES['rank_top20']})",
    "head_list_roundtrip": f"select layer, head_in_layer as head from ({ORACLES['retrieval_heads_topk']})",
    "masked_weights_roundtrip": f"select layer, proj, row_idx, w_sum from ({ORACLES['masked_weights']})",
}
