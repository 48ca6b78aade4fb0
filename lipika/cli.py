"""Command line: ``python -m lipika COMMAND``. Errors give exit code 1, a failed glyph check 2, an interrupt 130."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F

from lipika.errors import LipikaError
from lipika.functions import shaping
from lipika.functions import text as T
from lipika.operators import corpus, scoring, subword
from lipika.session import session
from lipika.sources import artefacts
from lipika.sources import text as sources

IN_SAMPLE = 2000


def _corpus(spark, args):
    if args.text:
        return sources.inline(spark, [args.text])
    if getattr(args, "corpus_config", None):
        return sources.corpus(spark, sources.config(args.corpus_config))
    if not args.input:
        return sources.sample(spark)
    lines = corpus.offset_limit(sources.load_paths(spark, args.input), 0, args.limit, list(sources.ORDER)) if args.limit else sources.load_paths(spark, args.input)
    return corpus.placed(lines, list(sources.ORDER), "doc_id").select("doc_id", F.col("line").alias("text"))


def _show(rows) -> None:
    for r in rows:
        print(json.dumps(r.asDict(recursive=True), ensure_ascii=False, indent=2))


def train(spark, args) -> int:
    docs = _corpus(spark, args)
    model = subword.train(docs, "doc_id", "text", args.scheme, args.algo, args.vocab_size, args.min_atom_freq, args.zwnj_policy, args.k_fused)
    artefacts.save(spark, model, args.model)
    _show(scoring.report(docs.orderBy("doc_id").limit(IN_SAMPLE), model, "doc_id", "text").collect())
    return 0


def evaluate(spark, args) -> int:
    _show(scoring.report(_corpus(spark, args), artefacts.load(spark, args.model), "doc_id", "text").collect())
    return 0


def encode(spark, args) -> int:
    coded = subword.encode(_corpus(spark, args), artefacts.load(spark, args.model), "doc_id", "text")
    _show(coded.select("ids", "surfaces", "roundtrip_ok").collect())
    return 0


def akshara(spark, args) -> int:
    chunks = _corpus(spark, args).select(F.explode(T.aksharas(F.col("text"))).alias("c")).select("c.*")
    names = F.transform(T.codepoints(F.col("text")), T.codepoint_name)
    _show(chunks.select("text", "kind", "start", "end", names.alias("codepoints")).collect())
    return 0


def featurize(spark, args) -> int:
    _show(_corpus(spark, args).select(F.explode(T.featurize(F.col("text"))).alias("x")).select("x.*").collect())
    return 0


def glyphs(spark, args) -> int:
    found = shaping.validate(_corpus(spark, args), "text", args.font)
    print(json.dumps(found, ensure_ascii=False))
    return 2 if found["status"] == "fail" else 0


def compare(spark, args) -> int:
    models = {m: artefacts.load(spark, m) for m in args.models}
    print(artefacts.markdown(scoring.compare(_corpus(spark, args), models, "doc_id", "text")))
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lipika", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    for f in (train, evaluate, encode, akshara, featurize, glyphs, compare):
        p = commands.add_parser(f.__name__)
        p.set_defaults(run=f)
        p.add_argument("--text")
        p.add_argument("--input", nargs="*", default=[])
        p.add_argument("--limit", type=int, help="lines of the input")
        if f in (train, evaluate, encode):
            p.add_argument("--model", required=True)
        if f is train:
            p.add_argument("--corpus-config", help="JSON: corpus_sources with weights, paths of their files, total_lines")
            p.add_argument("--scheme", choices=("grapheme", "akshara", "hybrid"), default="grapheme")
            p.add_argument("--algo", choices=("bpe", "unigram"), default="bpe")
            p.add_argument("--vocab-size", type=int, default=64000)
            p.add_argument("--min-atom-freq", type=int, default=2)
            p.add_argument("--zwnj-policy", choices=("preserve", "strip"), default="preserve")
            p.add_argument("--k-fused", type=int, default=200)
        if f is glyphs:
            p.add_argument("--font")
        if f is compare:
            p.add_argument("models", nargs="+")
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = session("lipika", "local[*]")
    spark.sparkContext.setLogLevel("ERROR")
    try:
        return args.run(spark, args)
    except LipikaError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    except KeyboardInterrupt:
        return 130
