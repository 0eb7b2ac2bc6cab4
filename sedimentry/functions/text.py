"""Text helpers as Column expressions, and two scorers that need Python."""

from __future__ import annotations

import difflib
import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

PRICE = r"\$[0-9,]+(?:\.[0-9]{2})?"


def price_tokens(text: Column) -> Column:
    """All dollar amounts; tokens without digits are dropped."""
    raw = F.regexp_extract_all(text, F.lit(PRICE), F.lit(0))
    values = F.transform(raw, lambda t: F.regexp_replace(t, "[$,]", "").try_cast("double"))
    return F.filter(values, lambda v: v.isNotNull())


def best_price(text: Column) -> Column:
    """The lowest whole-dollar amount as text; 'N/A' for no text, 'Price Not Found' for none in it."""
    low = F.array_min(F.transform(price_tokens(text), lambda v: F.floor(v)))
    return F.when(F.coalesce(F.length(F.trim(text)), F.lit(0)) == 0, "N/A").otherwise(F.coalesce(low.cast("string"), F.lit("Price Not Found")))


def html_text(html: Column) -> Column:
    """Visible text: no scripts, styles, comments or tags, white space collapsed."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"<[^>]*>", " "), r"\s+", " "))


def tag_density(html: Column) -> Column:
    return F.size(F.regexp_extract_all(html, F.lit(r"<[A-Za-z][^>]*>"), F.lit(0))) / (F.length(html) + 1)


def page_route(html: Column, marker: str = "__NEXT_DATA__", least: float = 0.01) -> Column:
    return F.when((tag_density(html) < least) | html.contains(marker), "browser").otherwise("static")


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matching characters over all characters; call it on distinct pairs of names."""
    known: dict[tuple[str, str], float] = {}
    out = []
    for pair in zip(a.fillna(""), b.fillna(""), strict=True):
        if pair not in known:
            known[pair] = difflib.SequenceMatcher(None, pair[0].lower(), pair[1].lower()).ratio() if pair[0] or pair[1] else 1.0
        out.append(known[pair])
    return pd.Series(out)


#: Our own abbreviations and synonyms, each spelled out before encoding.
LEXICON = {
    "spd": "speed", "vel": "speed", "velocity": "speed", "hr": "heart rate", "bpm": "rate", "pulse": "heart rate", "tmp": "temperature",
    "temp": "temperature", "prs": "pressure", "press": "pressure", "tyre": "tire", "brk": "brake", "eng": "engine", "sys": "systolic",
    "dia": "diastolic", "o2": "oxygen", "spo2": "oxygen saturation", "sat": "saturation", "resp": "respiration", "breaths": "respiration",
    "rev": "rpm", "revs": "rpm", "lat": "lateral", "long": "longitudinal", "acc": "acceleration", "accel": "acceleration", "amb": "ambient",
}


class NameEncoder:
    """Hashed character trigrams and words of a name, spelled out by the lexicon; unit length."""

    def __init__(self, size: int = 512, lexicon: dict[str, str] | None = None):
        self.size, self.lexicon = size, LEXICON if lexicon is None else lexicon

    def tokens(self, name: str) -> list[str]:
        flat = "".join(f" {c}" if c.isupper() and before.islower() else c if c.isalnum() else " " for before, c in zip(" " + name, name)).lower()
        return [t for part in flat.split() for t in self.lexicon.get(part, part).split()]

    def encode(self, name: str) -> np.ndarray:
        out = np.zeros(self.size)
        for token in self.tokens(name):
            grams = [f"={token}"] * 3 + [f"^{token}$"[i : i + 3] for i in range(len(token))]
            for gram in grams:
                out[int.from_bytes(hashlib.blake2b(gram.encode(), digest_size=4).digest(), "little") % self.size] += 1
        length = np.linalg.norm(out)
        return out / length if length else out

    def score(self, target: str, raw: str) -> float:
        return float(self.encode(target) @ self.encode(raw))
