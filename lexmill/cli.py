"""Command line: clean, similar, audit, backfill, extract, generate, pull, status, llm-check."""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.config import EngineConfig, load_config
from lexmill.functions import cards, clean
from lexmill.functions.patterns import pattern_key, vocab_key
from lexmill.functions.strings import term_key
from lexmill.models import prompts, runtime
from lexmill.operators import audit, backfill, chunk, merge, notes, rows, similar
from lexmill.sinks import writers
from lexmill.sinks.scratch import written
from lexmill.sources import files, web
from lexmill.sources.collection import read_collection

LANGS = ("zh", "ko")


def deck_tables(spark: SparkSession, args) -> tuple[dict[str, DataFrame], DataFrame, DataFrame] | None:
    """The collection's tables, the deck's ids and all note types; None without a deck."""
    if not args.deck_path or not args.deck:
        return None
    t = read_collection(spark, args.deck_path)
    ids = notes.deck_ids(args.deck, t["decks"], notes.legacy_decks(t["col"]))
    schemas = notes.union_first_wins(notes.legacy_schemas(t["col"]), notes.table_schemas(t["notetypes"], t["fields"]), key="mid")
    return t, ids, schemas


def deck_terms(spark: SparkSession, args) -> DataFrame:
    """(term): what the deck has already; no rows without a deck."""
    found = deck_tables(spark, args)
    if found is None:
        return spark.createDataFrame([], "term string")
    t, ids, schemas = found
    return notes.deck_words(t["notes"], t["cards"], ids, args.deck_field, schemas)


def provider_of(args) -> runtime.Provider:
    """The model that answers; a run that would write answers is refused without one."""
    if args.provider is None:
        sys.exit(f"{args.verb} needs a model: name a callable by --provider module:attribute")
    return runtime.load_provider(args.provider) if isinstance(args.provider, str) else args.provider


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at ``path``, on any file system that Spark can write to."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def refuse_existing(spark: SparkSession, path: str, overwrite: bool) -> str:
    if exists(spark, path) and not overwrite:
        sys.exit(f"{path} exists; use --overwrite")
    return "overwrite" if overwrite else "errorifexists"


def cmd_clean(spark: SparkSession, args, config: EngineConfig) -> None:
    lines = files.read_lines(spark, args.input).withColumn("c", clean.clean_line(F.col("term"), args.lang))
    kept = lines.filter("c.word IS NOT NULL").select("ord", F.col("c.word").alias("word"), clean.token(F.col("c")).alias("token"))
    first = rows.first_seen(kept, F.col("word"), "ord")
    new = rows.exclude(first, deck_terms(spark, args), term_key(F.col("word")), F.col("term"))
    out = args.output or writers.default_path("inputs", args.lang, args.date, "clean", "txt")
    mode = refuse_existing(spark, out, args.overwrite)
    # the result is materialised first, so that the output may replace its own input
    writers.write_single(written(new.select("ord", F.col("token").alias("line")), "clean"), [], out, mode=mode)


def cmd_similar(spark: SparkSession, args, config: EngineConfig) -> None:
    deck = deck_terms(spark, args)
    if args.input:
        terms = files.read_lines(spark, args.input).select("ord", clean.bare_word(F.col("term")).alias("term"))
    else:
        terms, deck = rows.numbered(deck, "term"), None
    pairs = similar.ranked(similar.find_similar(terms, args.lang, args.threshold, deck))
    if args.format == "csv" and args.output:
        lines = rows.numbered(writers.report_lines(pairs).withColumn("__k", F.monotonically_increasing_id()), "__k").select("ord", "line")
        writers.write_single(lines, [",".join(writers.REPORT_COLUMNS)], args.output)
        return
    groups = similar.clusters(pairs).orderBy(F.desc("size"), "cluster_id")
    for r in groups.toLocalIterator():  # a printed report, one group at a time
        print(f"{r['size']} similar: {', '.join(r['members'])}  (keep: {r['keep']})")


def _notes(spark: SparkSession, args) -> tuple[DataFrame, DataFrame]:
    found = deck_tables(spark, args)
    if found is None:
        sys.exit("audit needs --deck-path and --deck")
    t, ids, schemas = found
    names = notes.first_non_empty(t["decks"], notes.legacy_decks(t["col"]))
    return notes.deck_notes(t["notes"], t["cards"], ids, schemas), names


def cmd_audit(spark: SparkSession, args, config: EngineConfig) -> None:
    all_notes, names = _notes(spark, args)
    options = {"target": args.n, "include_empty_hanja": args.include_empty_hanja, "include_missing_notes": args.include_missing_notes, "check_content": args.check_content}
    flagged = written(audit.audit(all_notes, config.overrides, **options), "audit")
    writers.write_audit(flagged, names, args.output or writers.default_path("outputs", args.lang, args.date, "audit", "jsonl"))
    for r in audit.summarize(flagged).orderBy("code").collect():  # eleven codes at most
        print(f"{r['code']}: {r['n']}")


def ask(planned: DataFrame, config: EngineConfig, provider: runtime.Provider) -> DataFrame:
    """Answers by note to a plan's calls, each call made once."""
    c, requests = F.col, None
    lines = F.array_join(F.filter("kept_sentences", lambda s: backfill.lacks_headword(s, c("headword"))), "\n")
    for call, (system, user) in {
        "translate": prompts.translation(c("headword"), c("lang")), "sentence_call": prompts.sentences(c("headword"), c("lang"), c("needed")),
        "remark": prompts.remark(c("headword"), c("lang"), lines), "notes": prompts.notes(c("headword"), c("lang"), cards.bare_text(c("english"))),
    }.items():
        part = planned.filter(c(call) == 1).select(F.concat(F.lit(call + "/"), "guid").alias("id"), system.alias("system"), user.alias("user"))
        requests = part if requests is None else requests.unionByName(part)
    replies = written(runtime.model_stage(requests, provider, config), "replies")
    parsed = F.from_json("payload", "translation string, hanja string, sentences array<string>, notes string")
    by = replies.select(F.split_part("id", F.lit("/"), F.lit(1)).alias("call"), F.regexp_replace("id", "^[a-z_]+/", "").alias("guid"), parsed.alias("p"), "error")
    of = lambda call, what: F.first(F.when(c("call") == call, c(f"p.{what}")), ignorenulls=True)
    return by.groupBy("guid").agg(
        of("translate", "translation").alias("translation"), of("translate", "hanja").alias("hanja"), of("sentence_call", "sentences").alias("sentences"),
        of("remark", "sentences").alias("__marked"), F.coalesce(of("notes", "notes"), of("sentence_call", "notes")).alias("notes"), F.first("error", ignorenulls=True).alias("error"),
    ).withColumnRenamed("__marked", "remarked")


def cmd_backfill(spark: SparkSession, args, config: EngineConfig) -> None:
    entries = files.read_audit(spark, args.input).withColumnRenamed("model", "model_name")
    ready = audit.with_values(entries)
    if args.dry_run:
        row = backfill.estimate(ready, args.n, config.max_output_tokens, config.requests_per_minute).first()
        print(", ".join(f"{k}={v}" for k, v in row.asDict().items()))
        return
    out = args.output or writers.default_path("outputs", entries.first()["lang"] if not entries.isEmpty() else "ko", args.date, "backfill", "tsv")
    if exists(spark, out) and not args.overwrite:
        done = files.completed_guids(spark, f"{out}/*/*")
        ready = rows.exclude(ready, done, F.col("guid"), F.col("guid"))
    planned = written(backfill.plan(ready, args.n), "plan")
    repaired = backfill.repair(planned, ask(planned, config, provider_of(args)), args.n).filter(F.size("touched") > 0)
    line = backfill.update_line(F.col("model_name"), backfill.deck_label(F.col("deck_name"), F.lit("")), F.col("guid"), F.col("field_order"), F.col("fields"))
    writers.write_updates(repaired, line, out, "overwrite" if args.overwrite else "append")


def cmd_extract(spark: SparkSession, args, config: EngineConfig) -> None:
    """Vocabulary as a word list, grammar as JSON lines, or both; grammar goes to --grammar-output."""
    provider = provider_of(args)
    found = files.extract_text(files.list_files(spark, args.input, args.recursive), headings=args.mode != "vocab")
    parts = written(chunk.explode_chunks(found.filter("error IS NULL"), config.extract_chunk_tokens), "chunks")
    name = F.concat_ws("/", F.format_string("%012d", "ord"), F.format_string("%09d", "chunk"))

    def replies(system) -> DataFrame:
        requests = parts.select(name.alias("id"), system.alias("system"), F.col("chunk_text").alias("user"))
        return written(runtime.model_stage(requests, provider, config), "replies").filter("error IS NULL")

    if args.mode in ("vocab", "all"):
        out = args.output or writers.default_path(config.output_dir, args.lang, args.date, "", "txt")
        mode = refuse_existing(spark, out, args.overwrite)
        answered = replies(F.lit('List the vocabulary of a text. Reply with a JSON object: {"words": [..]}.'))
        words = answered.select("id", F.posexplode(runtime.words_of_reply(F.col("payload"))).alias("pos", "word"))
        merged = merge.merge_words(rows.numbered(words, "id", "pos").select("ord", "word"), args.lang)
        new = rows.exclude(merged, deck_terms(spark, args), term_key(clean.bare_word(F.col("word"))), F.col("term"))
        writers.write_single(new.select("ord", F.col("word").alias("line")), [], out, mode=mode)
    if args.mode in ("grammar", "all"):
        out = args.grammar_output or (args.output if args.mode == "grammar" else None) or writers.default_path(config.output_dir, args.lang, args.date, "grammar", "jsonl")
        mode = refuse_existing(spark, out, args.overwrite)
        answered = replies(prompts.grammar(F.lit(args.lang)))
        items = answered.select("id", F.posexplode(runtime.grammar_of_reply(F.col("payload"))).alias("pos", "g"))
        items = rows.numbered(items.select("id", "pos", "g.*"), "id", "pos")
        blank = {c: F.coalesce(c, F.lit("")) for c in ("explanation", "hanja")}
        merged = merge.merge_grammar(items.withColumns(blank), args.lang)
        key = pattern_key(F.col("pattern"), args.lang)
        new = rows.exclude(merged, deck_terms(spark, args), key, pattern_key(F.col("term"), args.lang))
        line = F.to_json(F.struct("pattern", "meaning", "explanation", "hanja", "examples"))
        writers.write_single(new.select("ord", line.alias("line")), [], out, mode=mode)


def cmd_generate(spark: SparkSession, args, config: EngineConfig) -> None:
    if args.mode == "grammar":
        generate_grammar(spark, args)
        return
    provider_of(args)  # refused before anything is read
    word, hanja = clean.split_hanja(F.col("term"))
    terms = files.read_lines(spark, args.input).select("ord", word.alias("headword"), hanja.alias("inline"))
    columns, key = writers.CARD_COLUMNS[args.lang, "vocab"], vocab_key(F.col("headword"), args.lang)
    left = rows.exclude(rows.first_seen(terms, key, "ord"), deck_terms(spark, args), key, vocab_key(F.col("term"), args.lang))
    out = args.output or writers.default_path("outputs", args.lang, args.date, "", "csv")
    resumed = exists(spark, out) and not args.overwrite
    if resumed:
        left = rows.exclude(left, files.completed_csv_keys(spark, out, columns[0], columns), key, F.col("key"))
    todo = written(left.select("ord", F.col("ord").cast("string").alias("guid"), "headword", "inline", F.lit(args.lang).alias("lang"), F.lit(args.n).alias("needed")), "todo")
    planned = todo.withColumns({"translate": F.lit(1), "sentence_call": (F.col("needed") > 0).cast("int"), "remark": F.lit(0), "notes": F.lit(0), "kept_sentences": F.array().cast("array<string>"), "english": F.lit("")})
    made = todo.join(ask(planned, config, provider_of(args)), "guid", "left").filter("error IS NULL")
    body = F.concat(cards.context_notes(F.col("notes")) if not args.no_notes else F.lit(""), cards.sentence_list(F.coalesce("sentences", F.array().cast("array<string>")), F.col("headword")))
    gloss = F.coalesce("translation", F.lit(""))
    cells = [F.col("headword"), F.lit(""), F.lit(""), gloss, body] if args.lang == "zh" else [F.col("headword"), F.coalesce(F.nullif("inline", F.lit("")), backfill.local_hanja(F.col("headword"))), gloss, body]
    writers.write_single(made.select("ord", writers.csv_line(*cells).alias("line")), [] if resumed else writers.csv_header(columns), out, mode="overwrite" if args.overwrite else "append")


def generate_grammar(spark: SparkSession, args) -> None:
    """Cards of grammar items read from JSON lines; they need no model."""
    items = rows.numbered(files.read_grammar(spark, args.input).withColumn("__line", F.monotonically_increasing_id()), "__line")
    key = pattern_key(F.col("pattern"), args.lang)
    left = rows.exclude(items, deck_terms(spark, args), key, pattern_key(F.col("term"), args.lang))
    columns = writers.CARD_COLUMNS["any", "grammar"]
    out = args.output or writers.default_path("outputs", args.lang, args.date, "grammar", "csv")
    resumed = exists(spark, out) and not args.overwrite
    if resumed:
        left = rows.exclude(left, files.completed_csv_keys(spark, out, columns[0], columns), key, pattern_key(F.col("key"), args.lang))
    cells = [F.col("pattern"), F.col("hanja"), cards.grammar_meaning(F.col("meaning"), F.col("explanation")), cards.grammar_examples(F.col("examples"), F.col("pattern"))]
    lines = written(left, "left").select("ord", writers.csv_line(*cells).alias("line"))
    writers.write_single(lines, [] if resumed else writers.csv_header(columns), out, mode="overwrite" if args.overwrite else "append")


def cmd_pull(spark: SparkSession, args, config: EngineConfig) -> None:
    """Cards of a saved endpoint reply or page; live sessions are the connector's own business."""
    raw = spark.read.text(args.input, wholetext=True).withColumnRenamed("value", "raw")
    payload = F.coalesce(web.inline_json(F.col("raw")), F.col("raw"))
    words = web.parse_cards(raw.select(payload.alias("payload")), traditional=args.traditional).select(F.col("ord").cast("bigint").alias("ord"), F.col("headword").alias("term"))
    new = rows.exclude(rows.first_seen(words, term_key(F.col("term")), "ord"), deck_terms(spark, args), term_key(F.col("term")), F.col("term"))
    out = args.output or writers.default_path("inputs", "zh", args.date, "pull", "txt")
    mode = refuse_existing(spark, out, args.overwrite)
    writers.write_single(new.select("ord", F.col("term").alias("line")), [], out, mode=mode)


def cmd_status(spark: SparkSession | None, args, config: EngineConfig) -> None:
    for name, value in sorted(config.__dict__.items()):
        print(f"{name}: {value}")
    print(f"extract_chunk_tokens: {config.extract_chunk_tokens}")


def cmd_llm_check(spark: SparkSession | None, args, config: EngineConfig) -> None:
    for probe in runtime.diagnose(config, runtime.stub_provider, os.environ.get("LEXMILL_API_KEY", "")):
        print(f"{'ok' if probe.ok else 'FAIL'} {probe.name} {probe.detail}".rstrip())


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lexmill", description=__doc__)
    verbs = top.add_subparsers(dest="verb", required=True)

    def verb(name, run, *, given="input", deck=True, lang="zh", overwrite=True):
        p = verbs.add_parser(name)
        p.set_defaults(run=run)
        if given:
            p.add_argument(given, nargs="?" if name == "similar" else None)
        p.add_argument("-o", "--output")
        p.add_argument("--date", default=date.today().strftime("%Y%m%d"), help="names default outputs")
        if lang:
            p.add_argument("--lang", choices=LANGS, default=lang)
        if overwrite:
            p.add_argument("--overwrite", action="store_true")
        if deck:
            p.add_argument("--deck-path")
            p.add_argument("--deck")
            p.add_argument("--deck-field", default=None)
        return p

    verb("clean", cmd_clean)
    p = verb("similar", cmd_similar, overwrite=False)
    p.add_argument("--threshold", type=float, default=0.80)
    p.add_argument("--format", choices=("text", "csv"), default="text")
    p = verb("audit", cmd_audit, given="", lang="ko", overwrite=False)
    p.add_argument("-n", type=int, default=3)
    for flag in ("--include-empty-hanja", "--include-missing-notes", "--check-content"):
        p.add_argument(flag, action="store_true")
    p = verb("backfill", cmd_backfill, deck=False, lang="")
    p.add_argument("-n", type=int, default=3)
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--provider")
    p = verb("extract", cmd_extract)
    p.add_argument("--mode", choices=("vocab", "grammar", "all"), default="vocab")
    p.add_argument("--recursive", action="store_true")
    p.add_argument("--grammar-output")
    p.add_argument("--provider", help="module:attribute of a callable (system, user, max_tokens)")
    p = verb("generate", cmd_generate)
    p.add_argument("-n", type=int, default=3)
    p.add_argument("--no-notes", action="store_true")
    p.add_argument("--mode", choices=("vocab", "grammar"), default="vocab")
    p.add_argument("--provider")
    p = verb("pull", cmd_pull, lang="")
    p.add_argument("--traditional", action="store_true")
    for name, run in (("status", cmd_status), ("llm-check", cmd_llm_check)):
        verb(name, run, given="", deck=False, lang="", overwrite=False)
    return top


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None, provider: runtime.Provider | None = None) -> None:
    from lexmill.session import get_session

    args = parser().parse_args(argv)
    if provider is not None:
        args.provider = provider
    config = load_config(os.environ, getattr(args, "lang", "") or "")
    if hasattr(args, "deck_path"):
        args.deck_path, args.deck = args.deck_path or config.deck_path, args.deck or config.deck_name
        from lexmill.config import parse_field

        args.deck_field = config.deck_field if args.deck_field is None else parse_field(args.deck_field)
    needs_spark = args.verb not in ("status", "llm-check")
    args.run(spark or (get_session() if needs_spark else None), args, config)


if __name__ == "__main__":
    main()
