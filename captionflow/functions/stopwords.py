"""Stopword sets: base lists plus spoken-language filler markers.

The base lists are fixed values: the word lists Apache Spark ships for
``pyspark.ml.feature.StopWordsRemover``, kept as plain text in
``stopword_lists/`` (``base_dir`` names another folder of such files).
"""

from __future__ import annotations

import functools
import os

import pandas as pd

# ---------------------------------------------------------------------------
# Spoken filler markers added to each base list. These must equal
# the reference's word lists for the same results; kept as plain text.
# ---------------------------------------------------------------------------
ORAL_MARKERS = {
    "pt": [
        "então", "né", "aí", "tipo", "assim", "cara", "gente", "tá", "tô",
        "isso", "esse", "essa", "esses", "essas", "aqui", "ali", "lá",
        "muito", "mais", "mas", "também", "já", "ainda", "agora", "bem",
        "sim", "não", "nunca", "sempre", "talvez", "quando", "onde", "porque", "porquê",
        "pronto", "legal", "beleza", "entende", "sabe", "certo", "ok", "ah", "eh", "uh", "hum",
        "aí", "então",
    ],
    "en": [
        "like", "just", "so", "actually", "basically", "literally", "yeah", "yes", "no",
        "not", "only", "own", "same", "so", "than", "too", "very", "can", "will", "just",
        "don", "now", "well", "right", "okay", "ok", "uh", "um", "ah", "know", "mean", "guess",
    ],
    "es": [
        "y", "o", "pero", "si", "no", "sí", "ya", "muy", "más", "también",
        "entonces", "pues", "bueno", "claro", "vale", "verdad", "así", "esto", "este", "esta",
        "ahora", "siempre", "nunca", "nada", "algo", "todo", "mucho", "poco", "bien", "mal",
        "eh", "ah", "uh", "mira", "venga", "oye",
    ],
}

# language code -> name of Spark's built-in list
BASE_LIST = {"pt": "portuguese", "en": "english", "es": "spanish", "fr": "french", "de": "german"}
# languages the reference knows; any other code uses the Portuguese set
PARITY_LANGS = ("pt", "en", "es")
DEFAULT_LANG = "pt"


BASE_DIR = os.path.join(os.path.dirname(os.path.abspath(__file__)), "stopword_lists")


@functools.lru_cache(maxsize=None)
def base_list(name: str, base_dir: str = BASE_DIR) -> tuple[str, ...]:
    with open(os.path.join(base_dir, f"{name}.txt"), encoding="utf-8") as f:
        return tuple(f.read().split())


@functools.lru_cache(maxsize=None)
def stopword_rows(native_lang: bool = False) -> tuple[tuple[str, str], ...]:
    """(set_key, term) rows: base list union oral markers, one set per key.

    ``native_lang=False`` keeps the reference's three sets (pt, en, es); with
    ``True`` French and German get their own base lists.
    """
    langs = list(PARITY_LANGS) + (["fr", "de"] if native_lang else [])
    rows = set()
    for lang in langs:
        for w in base_list(BASE_LIST[lang]):
            rows.add((lang, w))
        for w in ORAL_MARKERS.get(lang, []):
            rows.add((lang, w))
    return tuple(sorted(rows))


def stopword_set(lang: str, native_lang: bool = False) -> frozenset[str]:
    key = set_key(lang, native_lang)
    return frozenset(t for k, t in stopword_rows(native_lang) if k == key)


def set_key(lang: str | None, native_lang: bool = False) -> str:
    """Python twin of :func:`captionflow.functions.scalars.stopword_key`."""
    prefix = (lang or DEFAULT_LANG)[:2]
    known = PARITY_LANGS + (("fr", "de") if native_lang else ())
    return prefix if prefix in known else DEFAULT_LANG


def stopword_sets(spark, native_lang: bool = False):
    """DataFrame ``(lang, term)`` of all stopword sets (a few thousand rows, fixed)."""
    # from pandas it is a local relation (with Arrow), which no Python worker has to read
    rows = pd.DataFrame(list(stopword_rows(native_lang)), columns=["lang", "term"])
    return spark.createDataFrame(rows, "lang string, term string")


def sql_values(native_lang: bool = False) -> str:
    """The same rows as a SQL ``VALUES`` list, for oracle queries."""
    def q(s):
        return "'" + s.replace("'", "''") + "'"
    return ", ".join(f"({q(k)}, {q(t)})" for k, t in stopword_rows(native_lang))
