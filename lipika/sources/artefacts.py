"""Saving and loading trained vocabularies as small tables beside a JSON description."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lipika.errors import LoadError
from lipika.operators.dictionary import Dictionary
from lipika.operators.subword import Model

_TABLES = {
    "pieces": "piece string, atom string, is_fused boolean",
    "vocab": "id int, token string, score double",
    "merges": "rank int, left string, right string",
    "config": "json string",
}


def save(spark: SparkSession, model: Model, folder: str) -> None:
    """Write ``pieces``, ``vocab``, ``merges`` and ``config`` under the folder, in place of what is there."""
    made = model.made
    longer = sorted(made.fused - made.atoms.keys())  # a fused letter may have an atom only through its code points
    rows = {
        "pieces": [(p, a, p in made.fused) for p, a in made.atoms.items()] + [(p, None, True) for p in longer],
        "vocab": [(i, t, model.scores.get(t)) for t, i in model.vocab.items()],
        "merges": [(k, a, b) for k, (a, b) in enumerate(model.merges)],
        "config": [(json.dumps(model.config | {"scheme": made.scheme, "min_freq": made.min_freq}, ensure_ascii=False),)],
    }
    for name, schema in _TABLES.items():
        spark.createDataFrame(rows[name], schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}")


def load(spark: SparkSession, folder: str) -> Model:
    """The saved model; a missing or damaged part is a :class:`LoadError`."""
    try:
        parts = {name: spark.read.parquet(f"{folder}/{name}").collect() for name in _TABLES}
        config = json.loads(parts["config"][0]["json"])
        pieces = parts["pieces"]
        atoms = {r["piece"]: r["atom"] for r in sorted((r for r in pieces if r["atom"]), key=lambda r: r["atom"])}
        made = Dictionary(config.pop("scheme"), atoms, frozenset(r["piece"] for r in pieces if r["is_fused"]), config.pop("min_freq"))
        vocab = sorted(parts["vocab"], key=lambda r: r["id"])
        merges = [(r["left"], r["right"]) for r in sorted(parts["merges"], key=lambda r: r["rank"])]
        return Model(made, {r["token"]: r["id"] for r in vocab}, merges, {r["token"]: r["score"] for r in vocab if r["score"] is not None}, config | {"scheme": made.scheme})
    except (AnalysisException, KeyError, IndexError, TypeError, ValueError) as e:
        raise LoadError(f"no usable model in {folder}: {e}") from e


def save_rows(df: DataFrame, path: str) -> None:
    """Report rows as JSON lines, characters as they are."""
    df.coalesce(1).write.mode("overwrite").json(path)


def markdown(df: DataFrame) -> str:
    """Report rows (few) as a Markdown table; null is n/a."""
    rows = df.collect()
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *(line(["n/a" if v is None else str(v) for v in r]) for r in rows)])


def to_json(df: DataFrame) -> DataFrame:
    """Each row as a JSON string."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))
