"""Programs: python -m siftwork.cli NAME --help."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

from siftwork import config
from siftwork.functions import vocabulary
from siftwork.functions.tokens import EOS, tokenize as words_as_tokens
from siftwork.operators import bytepairs, heads, packing, probes, ranking, scoring, streams
from siftwork.session import prepare
from siftwork.sources import arriving, shards, tables
from siftwork.streaming import documents

VERSIONS = {"10B": "sample/10BT", "100B": "sample/100BT"}
#: Numbers of a stand-in vector for a token, for each head.
HEAD_NUMBERS = 4
log = logging.getLogger("siftwork")


def whole(text: str) -> int:
    """A number that may have underscores between its digits."""
    return int(text.replace("_", ""))


def _end(a: argparse.Namespace) -> int:
    return vocabulary.end_of_text(a.tokenizer) if a.tokenizer else EOS


def tokenize(spark: SparkSession, a: argparse.Namespace) -> None:
    """Documents (Parquet with doc_id and text) to token shards."""
    docs = spark.read.parquet(f"{a.documents}/{VERSIONS[a.version]}" if a.version else a.documents)
    if a.tokenizer:
        if bytepairs.fits(a.tokenizer):
            table = bytepairs.encode(docs, a.tokenizer, _end(a)).withColumn("failed", F.lit(False))
        else:
            table = vocabulary.token_table(docs, a.tokenizer)
        seen = Observation()
        made = table.observe(seen, F.count_if("failed").alias("failed")).checkpoint()
        log.info("documents that could not be tokenised: %d", seen.get["failed"])
        placed = packing.prefix_sum(made.select("doc_id", "n_tokens"), "doc_id", "n_tokens", "total_tokens_seen").drop("n_tokens")
        tokens = made.drop("failed").join(placed, "doc_id")
    else:
        tokens = packing.token_table(docs).join(packing.positions(docs).drop("n_tokens"), "doc_id")
    pieces = packing.slices(tokens, a.shard_size)
    shards.write(pieces.withColumn("shard", packing.shard_name(F.col("shard"))), a.out, a.manifest)


def score(spark: SparkSession, a: argparse.Namespace) -> None:
    """Token shards to scores of their documents. With a limit only the shards that it needs are opened, and frequencies are those of what is read."""
    pieces, known = streams.read(spark, a.data, a.order, a.max_tokens, _end(a))
    tokens = scoring.until(streams.split(pieces, known, _end(a)), a.max_tokens).checkpoint()
    made = scoring.ai_score(scoring.score(tokens, scoring.stand_in(scoring.frequencies(tokens)), a.seq_len, ("total_tokens_seen",)))
    micro = F.lit(float(scoring.MICRO))
    tables.write_scores(made.select("doc_id", (F.col("l_base") / micro).alias("L_base"), (F.col("l_ref") / micro).alias("L_ref"), F.col("ai_score").alias("AI_Score"), "total_tokens_seen"), a.out)


def follow(spark: SparkSession, a: argparse.Namespace) -> None:
    """Documents of the shards that have arrived in a folder, in any order, to Parquet; run again for what comes later, with the number of all once it is known."""
    if a.shards is not None:
        arriving.finish(a.data, a.shards)
    documents.run(spark, a.data, a.out, a.state, _end(a))


def rank(spark: SparkSession, a: argparse.Namespace) -> None:
    """Scores to the best or worst per cent of the documents."""
    # What is logged is counted by the passes that make the tables.
    every, seen = Observation(), Observation()
    scores = ranking.lengths(tables.read_scores(spark, a.scores).withColumnRenamed("AI_Score", "ai_score")).observe(every, F.max("total_tokens_seen").alias("total_tokens")).checkpoint()
    chosen = ranking.select(scores, a.top_pct, a.bottom_pct).observe(seen, F.count("*").alias("n_selected"), F.coalesce(F.sum("tok_len"), F.lit(0)).alias("selected_tokens")).checkpoint()
    tables.write_selection(chosen.withColumnRenamed("ai_score", "AI_Score"), a.out)
    total, found = every.get["total_tokens"], seen.get
    log.info("selected %d documents with %d of %d tokens, %.6f per cent", found["n_selected"], found["selected_tokens"], total or 0, 100.0 * found["selected_tokens"] / total if total else 0.0)


def make_probes(spark: SparkSession, a: argparse.Namespace) -> None:
    """Documents to retrieval probes."""
    pool = probes.pool(spark.read.parquet(a.documents))
    made = probes.prompts(probes.contexts(pool, a.n, a.seed), a.budget, a.seed)
    tables.write_probes(made.withColumnRenamed("probe_id", "id"), a.out)


def find_heads(spark: SparkSession, a: argparse.Namespace) -> None:
    """The heads that copy best: over probes, whose tokens have stand-in vectors, or over a table of vectors."""
    if a.probes:
        known = tables.read_probes(spark, a.probes)
        if a.tokenizer:
            made = vocabulary.prompt_and_answer(known, a.tokenizer)
        else:
            both, prompt = F.concat(F.coalesce("prompt", F.lit("")), F.lit(" "), F.coalesce("answer", F.lit(""))), F.coalesce("prompt", F.lit(""))
            made = known.select("id", words_as_tokens(both, None).alias("tokens"), F.size(words_as_tokens(prompt, None)).alias("n_prompt"))
        seq, prompt = heads.probe_sequences(made, vocabulary.stand_in_vector(F.col("token"), HEAD_NUMBERS * a.heads)), None
    elif a.vectors:
        seq, prompt = heads.sequences(spark.read.parquet(a.vectors), a.length), a.prompt
    else:
        raise SystemExit("find-heads: --probes or --vectors is needed")
    seq = seq.checkpoint()
    recall = heads.copy_recall(seq, heads.attention(seq, prompt, a.heads), prompt)
    tables.write_heads(heads.best_heads(recall, a.heads_per_layer, a.top_pct), a.out)


def mask_heads(spark: SparkSession, a: argparse.Namespace) -> None:
    """Attention weights (Parquet of layer, proj, row_idx, w) and a list of heads to weights with zeros in those heads' rows."""
    tables.write_weights(heads.masked(tables.read_weights(spark, a.weights), tables.read_heads(spark, a.heads), a.head_dim, a.n_heads, a.group), a.out)


def inspect(spark: SparkSession, a: argparse.Namespace) -> None:
    """One document by its pointer: tokens, losses, score, and its text where there is a tokenizer. Only the named ranges of the shards are read for it."""
    parts = [shards.read(spark, path, lo, hi).select(F.lit(k).alias("k"), "at", "tokens") for k, (path, lo, hi) in enumerate(shards.paths_of(a.doc_id, a.data))]
    pieces = parts[0]
    for p in parts[1:]:
        pieces = pieces.unionByName(p)
    one = pieces.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "at", "tokens"))), lambda s: s["tokens"])).alias("tokens")).select(F.lit(a.doc_id).alias("doc_id"), "tokens", F.size("tokens").alias("n_tokens")).checkpoint()
    share = scoring.frequencies(shards.read(spark, f"{a.data}/*.bin"))
    made = scoring.ai_score(scoring.score(one, scoring.stand_in(share), a.seq_len, ("n_tokens",)))
    log.info("%s", made.first().asDict())
    if a.tokenizer:
        print(bytepairs.decode(one, a.tokenizer).first()["text"] if bytepairs.fits(a.tokenizer) else one.select(vocabulary.decoded(a.tokenizer)("tokens")).first()[0])


def run_all(spark: SparkSession, a: argparse.Namespace) -> None:
    """Every step, in a folder: probes, heads, masked weights if there are any, shards, scores, selection. Shards that are there already stay."""
    out = a.folder.rstrip("/")
    steps = [
        ["make-probes", "--documents", a.documents, "--out", f"{out}/probes", "--n", str(a.n), "--budget", str(a.budget)],
        ["find-heads", "--probes", f"{out}/probes", "--out", f"{out}/heads", "--top-pct", "5", *(["--tokenizer", a.tokenizer] if a.tokenizer else [])],
        *([["mask-heads", "--weights", a.weights, "--heads", f"{out}/heads", "--out", f"{out}/masked", "--head-dim", str(a.head_dim), "--n-heads", "8"]] if a.weights else []),
        ["tokenize", "--documents", a.documents, "--out", f"{out}/shards", "--shard-size", str(a.shard_size), *(["--tokenizer", a.tokenizer] if a.tokenizer else [])],
        ["score", "--data", f"{out}/shards/*.bin", "--order", "number", "--out", f"{out}/scores", "--seq-len", str(a.seq_len), *(["--max-tokens", str(a.max_tokens)] if a.max_tokens else []), *(["--tokenizer", a.tokenizer] if a.tokenizer else [])],
        ["rank", "--scores", f"{out}/scores/tsv", "--out", f"{out}/selection", "--top-pct", str(a.top_pct)],
    ]
    for step in steps:
        if step[0] == "tokenize" and shards.exists(f"{out}/shards/*.bin"):
            log.info("shards are there already")
            continue
        log.info("step %s", step[0])
        main(step, spark)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="siftwork")
    sub = top.add_subparsers(required=True)

    def program(f, *options):
        p = sub.add_parser(f.__name__.replace("_", "-"), help=f.__doc__)
        for name, kind, default in options:
            p.add_argument(f"--{name}", type=kind, default=default, required=default is ...)
        p.add_argument("--config", help="file of settings for options that aren't given")
        p.set_defaults(run=f)
        return p

    coder = ("tokenizer", str, None)
    made = program(tokenize, ("documents", str, ...), ("out", str, ...), ("shard-size", whole, 10**8), coder)
    made.add_argument("--manifest", action="store_true", help="for stores without renaming: one file says which of the others are shards")
    made.add_argument("--version", choices=sorted(VERSIONS), help="the sample of that size, in its own folder under the documents")
    program(score, ("data", str, ...), ("out", str, ...), ("seq-len", int, 4096), ("max-tokens", whole, None), coder).add_argument("--order", choices=streams.ORDERS, default="name", help="of shards: by name, or by the numbers that names end in")
    program(follow, ("data", str, ...), ("out", str, ...), ("state", str, ...), ("shards", int, None), coder)
    program(rank, ("scores", str, ...), ("out", str, ...), ("top-pct", float, 20.0), ("bottom-pct", float, None))
    program(make_probes, ("documents", str, ...), ("out", str, ...), ("n", int, 800), ("budget", int, 4096), ("seed", str, "42"))
    program(find_heads, ("probes", str, None), ("vectors", str, None), ("out", str, ...), ("length", int, 50), ("prompt", int, 40), ("heads", int, 16), ("heads-per-layer", int, 8), ("top-pct", float, 5.0), coder)
    program(mask_heads, ("weights", str, ...), ("heads", str, ...), ("out", str, ...), ("head-dim", int, ...), ("n-heads", int, ...), ("group", int, 1))
    program(inspect, ("data", str, ...), ("doc-id", str, ...), ("seq-len", int, 4096), coder)
    program(
        run_all, ("documents", str, ...), ("folder", str, ...), ("weights", str, None), ("head-dim", int, 4), ("n", int, 800), ("budget", int, 4096), ("shard-size", whole, 10**8), ("seq-len", int, 4096), ("max-tokens", whole, 100_000),
        ("top-pct", float, 20.0), coder,
    )
    return top


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    known = parser()
    a, _ = known.parse_known_args(args) if args is not None else known.parse_known_args()
    settings = config.read(a.config)
    # What the file says comes before the defaults, and what is given before the file.
    for action in known._subparsers._group_actions:
        for p in action.choices.values():
            p.set_defaults(**{k: v for k, v in config.options(settings).items() if any(x.dest == k and not x.required for x in p._actions)})
    a = known.parse_args(args)
    global log
    log = config.logger(settings)
    a.run(prepare(spark or SparkSession.builder.getOrCreate()), a)


if __name__ == "__main__":
    main()
