"""One form for text that looks the same: compatibility forms, invisible marks and look-alike letters.

After deleting what can't be seen and replacing compatibility forms, every
token that holds a letter with look-alikes in another script becomes a
lattice: each of its letters with the letters it could stand for. The best
path by Viterbi under character n-gram scores, learned from all texts, and a
price for changing the script inside a token, is the token's form.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellon.llm.tokens import IGNORABLE

# Letters of several scripts that look the same; of each group the Latin one comes first.
GROUPS = (
    "AАΑᎪ", "BВΒᏴ", "CСϹᏟ", "EЕΕᎬ", "HНΗᎻ", "IІΙӀ", "JЈᎫ", "KКΚᏦ", "LᏞ", "MМΜᎷ", "NΝ", "OОΟՕ", "PРΡᏢ", "SЅՏᏚ", "TТΤᎢ", "UՍ", "VѴᏙ", "WԜᎳ", "XХΧ", "YҮΥУ", "ZΖᏃ",
    "aа", "cсϲ", "dԁ", "eе", "gց", "hһհ", "iі", "jјϳ", "lӏ", "nո", "oоοօ", "pр", "qԛզ", "sѕ", "uս", "vѵ", "wԝ", "xх", "yу", "GԌᏀ",
)
# Letters that only resemble each other; considered inside tokens that mix scripts.
RESEMBLING = ("aαɑ", "vν", "pρ", "uυ", "iιı", "kкκ", "tтτ", "rг", "nпц", "bь", "FҒ", "yγү", "gɡԍ", "xχ", "eє")
# Latin letters that look like usual Greek or Cyrillic ones, so that they are no evidence of their script.
SHARED = "aceiopsxyjvABCEHIJKMNOPSTXYZ"
#: Letters of other scripts with the Latin one that looks the same.
EXACT = {c: g[0] for g in GROUPS for c in g[1:]}
ALIKE: dict[str, str] = {}
for _g in GROUPS:
    ALIKE |= {c: _g.replace(c, "") for c in _g}
NEAR: dict[str, str] = {}
for _g in RESEMBLING:
    for _c in _g:
        NEAR[_c] = NEAR.get(_c, "") + _g.replace(_c, "")
#: Compatibility forms that look like what they stand for.
_SAME_LOOK = ("<wide>", "<narrow>", "<font>", "<compat>", "<noBreak>")
_SPACES = "               　"
#: Texts without any of these are in their form already but for compatibility punctuation.
SUSPECT = "[^\\x00-\\x7e\\u4e00-\\u9fff\\u3001\\u3002\\u300a-\\u3011\\uff08\\uff09\\uff0c\\uff1a\\uff1b\\uff01\\uff1f\\u2014\\u2018\\u2019\\u201c\\u201d\\u2026]"
#: Log prices: a change of script inside a token, taking a letter for another, for one that only resembles it; leaving the one script that all of a token is written in; a script that nothing else in the text is written in.
SCRIPT_CHANGE, SUBSTITUTION, RESEMBLANCE, LEAVING, STRANGER = 7.0, 1.0, 2.0, 4.0, 9.0
_EDGE = "\x02"


def _script(c: str) -> str:
    """The script of a letter: l, g, c, a for Armenian, k for Cherokee."""
    o = ord(c)
    if 0x370 <= o <= 0x3FF or 0x1F00 <= o <= 0x1FFF:
        return "g"
    if 0x400 <= o <= 0x52F:
        return "c"
    if 0x530 <= o <= 0x58F:
        return "a"
    if 0x13A0 <= o <= 0x13FF:
        return "k"
    return "l"


_LETTER = "A-Za-zÀ-ɏɐ-ʯͰ-ϿЀ-ԯ԰-֏Ꭰ-ᏽḀ-῿"
#: Tokens of letters of the scripts that the lattice knows.
TOKEN = re.compile(f"[{_LETTER}]+")


def stands_in(c: str) -> str | None:
    """The kind of stand-in that the single character c is by itself, or None."""
    if c in IGNORABLE:
        return "invisible"
    if c in _SPACES:
        return "space"
    kind = unicodedata.category(c)
    if kind[0] not in "LNS" or ord(c) < 0x80:
        return None
    o = ord(c)
    if kind == "So" and not 0x2E80 <= o <= 0x2FDF:
        return None
    if 0x3130 <= o <= 0x318F or o == 0xFF5E:
        return None
    parts = unicodedata.decomposition(c).split()
    if not parts:
        return None
    if parts[0].startswith("<"):
        return "compatibility" if parts[0] in _SAME_LOOK else None
    return "compatibility" if len(parts) == 1 else None


def plain(text: str) -> str:
    """text without ignorable characters, in compatibility form."""
    return unicodedata.normalize("NFKC", text.translate(dict.fromkeys(map(ord, IGNORABLE))))


class Scores:
    """Log probabilities of a character after another, with add-one smoothing inside each script."""

    def __init__(self, counts: dict[str, int]):
        self.pair = dict(counts)
        self.first: dict[str, int] = {}
        for p, n in counts.items():
            self.first[p[0]] = self.first.get(p[0], 0) + n

    def step(self, a: str, b: str) -> float:
        la, lb = a.lower(), b.lower()
        s = math.log((self.pair.get(la + lb, 0) + 0.1) / (self.first.get(la, 0) + 30.0))
        if _EDGE not in (a, b) and _script(a) != _script(b):
            s -= SCRIPT_CHANGE
        return s


def scripts_of(text: str) -> frozenset[str]:
    """The scripts of which the text has letters that look like those of no other."""
    return frozenset(_script(c) for c in set(text) if c.isalpha() and ord(c) < 0x2000 and (c not in SHARED if c.isascii() else c not in ALIKE and c not in NEAR))


def in_doubt(token: str) -> bool:
    """Whether any letter of the token could stand for another: those of other scripts, those of mixed tokens."""
    scripts = {_script(c) for c in token}
    if len(scripts) > 1:
        return any(c in ALIKE or c in NEAR for c in token)
    return any(c in EXACT for c in token)


def token_form(token: str, scores: Scores, known: frozenset[str] = frozenset()) -> str:
    """The best path through the token's lattice: each letter as it stands or as a look-alike, under the pair scores, a price for each change of script, and the scripts `known` from the rest of the text."""
    scripts = {_script(c) for c in token}
    own = next(iter(scripts)) if len(scripts) == 1 else ""
    paths: list[tuple[float, str]] = [(0.0, "")]
    for c in token:
        options = [(c, 0.0)] + [(o, SUBSTITUTION) for o in ALIKE.get(c, "")]
        if not own and len(token) > 1:
            options += [(o, RESEMBLANCE) for o in NEAR.get(c, "")]
        best: dict[str, tuple[float, str]] = {}
        for value, path in paths:
            for o, price in options:
                s = value + scores.step(path[-1] if path else _EDGE, o) - price
                if not path:
                    # a script that the text uses nowhere else, or that is not the token's, is unlikely from the start
                    s -= STRANGER if known and _script(o) not in known else 0.0
                    s -= LEAVING if own and _script(o) != own and (not known or own in known) else 0.0
                if o not in best or s > best[o][0]:
                    best[o] = (s, path + o)
        paths = list(best.values())
    return max((value + scores.step(path[-1], _EDGE), path) for value, path in paths)[1]


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n): neighbouring letters inside the tokens of rows' `text`, lower case, _EDGE at both ends; null texts count nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = 0x2000
        letter = np.zeros(0x110000, bool)
        letter[[i for i in range(size) if re.match(f"[{_LETTER}]", chr(i))]] = True
        for p in batches:
            joined = "\n" + "\n".join(p["text"]).translate(dict.fromkeys(map(ord, IGNORABLE)))
            joined = unicodedata.normalize("NFKC", joined).lower() + "\n"
            codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
            codes = np.where(letter[codes], codes, ord(_EDGE)).astype(np.int64)
            key = codes[:-1] * size + codes[1:]
            key, n = np.unique(key, return_counts=True)
            keep = key != ord(_EDGE) * size + ord(_EDGE)
            yield pd.DataFrame({"pair": [chr(k // size) + chr(k % size) for k in key[keep]], "n": n[keep]})

    counted = rows.select("text").where("text <> ''").mapInPandas(run, "pair string, n bigint")
    return counted.groupBy("pair").agg(F.sum("n").alias("n"))


def learn(rows: DataFrame) -> Scores:
    """Scores from all texts of rows (text). The pairs brought to the driver are those of an alphabet of some 2,000 letters, whatever the texts."""
    return Scores({r["pair"]: r["n"] for r in pair_counts(rows).toLocalIterator()})


#: What a text must hold for any of its tokens to be in doubt.
_DOUBT = re.compile(f"[{''.join(c for c in EXACT)}{''.join(c for c in NEAR if not c.isascii())}]")


def form_of(text: str, scores: Scores) -> tuple[str, list[str]]:
    """(form, kinds of stand-ins found) of a text."""
    kinds = {k for c in set(text) if (k := stands_in(c))}
    seen = text.translate(dict.fromkeys(map(ord, IGNORABLE)))
    if any(unicodedata.combining(c) for c in seen) and unicodedata.normalize("NFC", seen) != seen:
        kinds.add("combining")
    form = unicodedata.normalize("NFKC", seen)
    if _DOUBT.search(form):
        known = scripts_of(form)
        fixed = TOKEN.sub(lambda m: token_form(m[0], scores, known) if in_doubt(m[0]) else m[0], form)
        if fixed != form:
            kinds.add("look_alike")
            form = fixed
    return form, sorted(kinds)


def forms(rows: DataFrame, scores: Scores | None = None) -> DataFrame:
    """rows with `form` string and `kinds` array<string> added.

    rows: `text` string and other columns, none named form or kinds. A null
    text has a null form and no kinds; an empty one an empty form. Without
    scores they are learned from rows.
    """
    if clash := {"form", "kinds"} & set(rows.columns):
        raise ValueError(f"rows has columns of the result: {sorted(clash)}")
    known = scores or learn(rows)
    made = "form string, kinds array<string>"

    @F.pandas_udf(made)
    def run(texts: pd.Series) -> pd.DataFrame:
        out = [(None, []) if t is None else form_of(t, known) for t in texts]
        return pd.DataFrame({"form": [f for f, _ in out], "kinds": [k for _, k in out]})

    return rows.withColumn("_f", run("text")).select(*rows.columns, "_f.form", "_f.kinds")


def stand_ins(rows: DataFrame, scores: Scores | None = None) -> DataFrame:
    """The rows whose text holds a stand-in or an unseen mark, with form and kinds."""
    known = scores or learn(rows)
    return forms(rows.where(F.col("text").rlike(SUSPECT)), known).where(F.size("kinds") > 0)
