"""Glyph checks with a shaping library, where it is installed; else the check is skipped, never passed."""

from __future__ import annotations

import importlib.util
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lipika.functions import text as T

FOLDERS = ("/usr/share/fonts", "/usr/local/share/fonts", "/System/Library/Fonts", "/Library/Fonts")
NAMES = ("bengali", "lohit", "kohinoor", "vrinda", "nirmala")


def find_font(folders: tuple[str, ...] = FOLDERS) -> str | None:
    """The first font file whose name tells of the script."""
    for top in folders:
        for place, _, files in sorted(os.walk(top)):
            for f in sorted(files):
                if f.lower().endswith((".ttf", ".otf")) and any(n in f.lower() for n in NAMES):
                    return os.path.join(place, f)
    return None


def validate(df: DataFrame, text: str, font: str | None = None, most: int = 20) -> dict:
    """``status`` (pass, fail or skipped), ``reason``, counts, and at most ``most`` failing texts: those with a missing glyph, or whose shaping clusters are not their grapheme clusters."""
    font = font or find_font()
    if importlib.util.find_spec("uharfbuzz") is None:
        return {"status": "skipped", "reason": "the shaping library is not installed", "n_missing": None, "failures": []}
    if not font:
        return {"status": "skipped", "reason": "no font was found", "n_missing": None, "failures": []}

    @F.pandas_udf("missing int, clusters int")
    def shaped(texts):
        import pandas as pd
        import uharfbuzz as hb

        shaper = hb.Font(hb.Face(hb.Blob.from_file_path(font)))

        def count(t):
            buffer = hb.Buffer()
            buffer.add_str(t)
            buffer.guess_segment_properties()
            hb.shape(shaper, buffer)
            return sum(g.codepoint == 0 for g in buffer.glyph_infos), len({g.cluster for g in buffer.glyph_infos})

        return pd.DataFrame([count(t) for t in texts], columns=["missing", "clusters"])

    norm = T.normalize(F.col(text))
    rows = df.filter(~T.is_blank(F.col(text))).select(F.col(text).alias("text"), shaped(norm).alias("s"), T.num_clusters(norm).alias("graphemes"))
    bad = (F.col("s.missing") > 0) | (F.col("s.clusters") != F.col("graphemes"))
    count = lambda c: F.coalesce(F.sum(c), F.lit(0))
    total = rows.agg(count("s.missing").alias("missing"), count(bad.cast("int")).alias("failed"), F.count("*").alias("checked")).first()
    failures = [r["text"] for r in rows.filter(bad).limit(most).collect()]
    return {"status": "fail" if total["failed"] else "pass", "reason": font, "checked": total["checked"], "n_failures": total["failed"], "n_missing": total["missing"], "failures": failures}
