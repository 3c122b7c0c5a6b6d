"""Evaluation texts in training text, by spaced-seed hashing.

A seed is a mask over a run of tokens; hashing only the positions it keeps
finds a run although other positions were substituted. Every run of an
evaluation item and every run of a corpus text is hashed under each mask, and
the two sides are joined on the hash. Where they meet, text and item are
compared token by token along the diagonal of the hit.

The corpus is read once, whatever the number of items: a filter of bounded
size, made of the items' hashes, tells which runs can meet any item, and only
the hashes of those, with the tokens of their texts, go into the join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellon.llm import filters, tokens
from tessellon.plans.lineage import cut

#: Kept positions of a run; words (10 long) and characters (14 long). The first mask of each has the most weight at the ends.
MASKS = {False: ("1101100111", "1110011011"), True: ("11011001110111", "11100110110111")}
_IDEOGRAPHS = "[぀-ヿ㐀-鿿豈-﫿\U00020000-\U000323af⺀-⿟]"


def _weights(mask: str) -> np.ndarray:
    odd = np.random.default_rng(len(mask)).integers(1, 1 << 62, len(mask), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return np.where(np.frombuffer(mask.encode(), np.uint8) == ord("1"), odd, np.uint64(0))


def _seeds(h: np.ndarray, doc: np.ndarray, chars: bool) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of all runs under all masks."""
    found = [tokens.windows(h, doc, _weights(mask)) for mask in MASKS[chars]]
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _encoded(items: DataFrame) -> DataFrame:
    """(no, item_id, chars, n, tokens): items with the hashes of their tokens as bytes; those without a run drop out."""
    kind = dict(items.dtypes)["item_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            texts = p["text"].tolist()
            ideo = tokens.is_ideographic(texts) if texts else np.empty(0, bool)
            for chars in (False, True):
                of = np.nonzero(ideo == chars)[0]
                h, doc = tokens.tokenise([texts[i] for i in of], chars)
                at = np.searchsorted(doc, np.arange(len(of) + 1))
                long = np.nonzero(np.diff(at) >= len(MASKS[chars][0]))[0]
                yield pd.DataFrame({"item_id": p["item_id"].to_numpy()[of[long]], "chars": chars, "n": np.diff(at)[long], "tokens": [h[at[i] : at[i + 1]].tobytes() for i in long]})

    made = items.mapInPandas(run, f"item_id {kind}, chars boolean, n int, tokens binary")
    return cut(made.withColumn("no", F.monotonically_increasing_id()))


def _item_seeds(encoded: DataFrame) -> DataFrame:
    """(h, no, at): the hashes of the items' runs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for chars in (False, True):
                own = p[p["chars"] == chars]
                if not len(own):
                    continue
                h = np.frombuffer(b"".join(own["tokens"]), np.uint64)
                n = own["n"].to_numpy()
                doc = np.repeat(np.arange(len(own)), n)
                seed, start = _seeds(h, doc, chars)
                begin = np.cumsum(n) - n
                yield pd.DataFrame({"h": seed.view(np.int64), "no": own["no"].to_numpy()[doc[start]], "at": (start - begin[doc[start]]).astype(np.int32)})

    return encoded.select("no", "chars", "n", "tokens").mapInPandas(run, "h bigint, no bigint, at int")


def _meeting(corpus: DataFrame, words: np.ndarray, kinds: list[bool]) -> DataFrame:
    """(uid, doc_id, tokens, hits): corpus texts with runs that may meet an item; hits are (h, start). A text that may meet items of both kinds has two rows."""
    kept = corpus.sparkSession.sparkContext.broadcast(words)
    schema = f"doc_id {dict(corpus.dtypes)['doc_id']}, tokens binary, hits array<struct<h: bigint, start: int>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for chars in kinds:
                own = p[p["text"].str.contains(_IDEOGRAPHS, regex=True)] if chars else p
                if not len(own):
                    continue
                h, doc = tokens.tokenise(own["text"].tolist(), chars)
                seed, start = _seeds(h, doc, chars)
                left = filters.may_hold(kept.value, seed)
                if not len(left):
                    continue
                seed, start = seed[left], start[left]
                order = np.argsort(start, kind="stable")
                seed, start = seed[order].view(np.int64), start[order]
                text, first = np.unique(doc[start], return_index=True)
                begin, end = np.searchsorted(doc, text), np.searchsorted(doc, text, "right")
                last = np.append(first[1:], len(start))
                yield pd.DataFrame({
                    "doc_id": own["doc_id"].to_numpy()[text],
                    "tokens": [h[a:b].tobytes() for a, b in zip(begin, end)],
                    "hits": [[{"h": x, "start": y} for x, y in zip(seed[i:j].tolist(), (start[i:j] - a).tolist())] for i, j, a in zip(first, last, begin)],
                })

    return cut(corpus.mapInPandas(run, schema).withColumn("uid", F.monotonically_increasing_id()))


def _covered(same: np.ndarray, diagonal: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Which positions lie in unbroken runs of at least `span` equal tokens, and which in stretches of `span` of which at most one in four differs; neither goes beyond its diagonal."""
    n = len(same)
    if not n:
        return same, same
    new = np.ones(n, bool)
    new[1:] = (same[1:] != same[:-1]) | (diagonal[1:] != diagonal[:-1])
    number = np.cumsum(new) - 1
    exact = same & (np.bincount(number)[number] >= span)
    loose = np.zeros(n + 1, np.int64)
    if n >= span:
        total = np.concatenate([[0], np.cumsum(same)])
        start = np.nonzero((total[span:] - total[:-span] >= span - span // 4) & (diagonal[span - 1 :] == diagonal[: n - span + 1]))[0]
        np.add.at(loose, start, 1)
        np.add.at(loose, start + span, -1)
    return exact, np.cumsum(loose)[:n] > 0


def _shares(chars: pd.Series, item: pd.Series, low: pd.Series, parts: pd.Series) -> pd.DataFrame:
    """The shares of items covered along their diagonals: item holds an item's tokens, low and parts where in it each diagonal begins and the text's tokens along it."""
    out = np.zeros((2, len(item)))
    for kind in (False, True):
        own = np.nonzero(chars.to_numpy() == kind)[0]
        if not len(own):
            continue
        have = np.frombuffer(b"".join(item.iloc[own]), np.uint64)
        n = np.array([len(x) // 8 for x in item.iloc[own]])
        base = np.cumsum(n) - n
        count = np.array([len(x) for x in low.iloc[own]])
        begin = np.repeat(base, count) + np.concatenate([np.asarray(x, np.int64) for x in low.iloc[own]])
        pieces = [y for x in parts.iloc[own] for y in x]
        size = np.array([len(x) // 8 for x in pieces])
        diagonal = np.repeat(np.arange(len(size)), size)
        at = np.repeat(begin, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        owner = np.repeat(np.arange(len(own)), n)
        for i, covered in enumerate(_covered(have[at] == np.frombuffer(b"".join(pieces), np.uint64), diagonal, len(MASKS[kind][0]))):
            mark = np.zeros(len(have), bool)
            mark[at[covered]] = True
            out[i, own] = np.bincount(owner[mark], minlength=len(own)) / np.maximum(n, 1)
    return pd.DataFrame({"exact_share": out[0], "tolerant_share": out[1]})


def leaks(corpus: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, exact_share, tolerant_share): corpus texts (doc_id, text) with the evaluation items (item_id, text) of which they hold passages.

    exact_share: the part of the item's tokens that stands in the text in
    unbroken runs of at least 10 words (items in ideographs: 14 characters),
    case, punctuation and spacing aside; tolerant_share: the same where a
    quarter of a run may be substituted. Pairs of which both are 0 have no row.
    Null and empty texts, null ids and items shorter than a run take no part;
    of a repeated item_id the smallest text counts; repeated doc_ids come out
    once for each row. The corpus is read once.
    """
    items = items.where("item_id is not null and text <> ''").groupBy("item_id").agg(F.min("text").alias("text"))
    encoded = _encoded(items)
    seeds = cut(_item_seeds(encoded))
    kinds = sorted(r["chars"] for r in encoded.select("chars").distinct().collect())  # two values at most
    corpus = corpus.select("doc_id", "text").where("doc_id is not null and text <> ''")
    met = _meeting(corpus, filters.build(seeds), kinds)
    hits = met.select("uid", F.explode("hits").alias("x")).select("uid", "x.h", "x.start")
    diagonals = hits.join(seeds, "h").select("uid", "no", (F.col("start") - F.col("at")).alias("shift")).distinct()
    # along a diagonal only as much of the text is kept as the item is long
    own = diagonals.join(encoded.select("no", "n"), "no").join(met.select("uid", "doc_id", "tokens"), "uid")
    low = F.greatest(F.lit(0), -F.col("shift"))
    part = F.substring("tokens", 8 * F.greatest(F.lit(0), F.col("shift")) + 1, 8 * (F.col("n") - low))
    own = own.select("uid", "doc_id", "no", F.struct(low.alias("low"), part.alias("part")).alias("d")).groupBy("uid", "no").agg(F.first("doc_id").alias("doc_id"), F.collect_list("d").alias("d"))
    both = own.join(encoded.select("no", "item_id", "chars", F.col("tokens").alias("item")), "no")
    shares = F.pandas_udf(_shares, "exact_share double, tolerant_share double")
    got = both.select("doc_id", "item_id", shares("chars", "item", F.col("d.low"), F.col("d.part")).alias("s"))
    return got.select("doc_id", "item_id", "s.exact_share", "s.tolerant_share").where("tolerant_share > 0 or exact_share > 0")
