"""Subject areas of documents by a distributed latent Dirichlet topic model.

A document has a Dirichlet mixture of topics, a sentence one topic drawn from
it, and the sentence's terms come from that topic. Topics are fitted to all
documents by variational passes; they begin at the terms that stand out in
labelled documents of each area, with further topics free for what belongs to
no area. After the fit each topic's top terms are inspected: a topic goes to
the area in whose labelled documents most of them stand out, or to none. A
document's areas are those with enough of its sentences.

Terms are words, and in ideographic script pairs of neighbouring characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellon.llm import tokens
from tessellon.plans.lineage import cut


def _terms(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, sentence number, start, length, codes) of the terms of texts in order; sentences count over all texts."""
    t = tokens._tables()
    codes, doc = tokens.codes_of(texts)
    n = len(codes)
    # one look-up for all classes: 1 letter, 2 ideograph, 4 end of a sentence, 8 full stop, 16 digit
    kinds = np.zeros(len(t.word), np.uint8)
    kinds[t.word] = 1
    kinds[t.ideograph & t.word] = 2
    kinds[48:58] = 16
    kinds[[10, 13, 0x21, 0x3F, 0x3002, 0xFF01, 0xFF1F, 0xFF61, 0]] = 4
    kinds[0x2E] = 8
    kind = kinds[codes]
    stop = kind == 4
    dots = np.nonzero(kind[:-1] == 8)[0] if n > 1 else np.empty(0, np.int64)
    stop[dots] = (kind[dots + 1] & 19) == 0
    sentence = np.cumsum(stop, dtype=np.int32)
    letters, ideo = kind == 1, kind == 2
    at = np.nonzero(letters)[0]
    out = []
    if len(at):
        first = np.ones(len(at), bool)
        first[1:] = at[1:] != at[:-1] + 1
        begin = np.nonzero(first)[0]
        length = np.diff(np.append(begin, len(at)))
        place = np.arange(len(at)) - np.repeat(begin, length)
        h = tokens.mix(codes[at].astype(np.uint64) + np.uint64(0x9E3779B9)) * t.powers[np.minimum(place, tokens._LONGEST - 1)]
        keep = (length >= 3) & (length <= 40)
        out.append((tokens.mix(np.add.reduceat(h, begin))[keep], at[begin][keep], length[keep]))
    if n > 1:
        two = np.nonzero(ideo[:-1] & ideo[1:])[0]
        a, b = codes[two].astype(np.uint64), codes[two + 1].astype(np.uint64)
        out.append((tokens.mix(a * np.uint64(0x200001) + b + np.uint64(77)), two, np.full(len(two), 2)))
    # both kinds in one order of place, without a sort: no two begin at one place
    hashes, lengths = np.zeros(n, np.uint64), np.zeros(n, np.int8)
    for h, start, length in out:
        hashes[start], lengths[start] = h, length
    start = np.nonzero(lengths)[0]
    h, length = hashes[start], lengths[start]
    return h.view(np.int64), doc[start], sentence[start], start, length, codes


def vocabulary(rows: DataFrame, least: int, rare: float, most: float) -> pd.DataFrame:
    """(h, term, df), most frequent first: the terms of rows (text) that at least `least` texts hold and the part `rare` of all, and at most the part `most`. df counts all texts.

    What a model of topics can say of a term rests on the texts that hold it;
    the part, the same at every size, bounds the model: with d different terms
    in the mean text there are d / rare terms at most.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            h, doc, _, start, length, codes = _terms(p["text"].tolist())
            if not len(p):
                continue
            order = np.argsort(h, kind="stable")  # texts stay in order under each term
            h, doc, start, length = h[order], doc[order], start[order], length[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            # h is in order, so its distinct values begin where it changes
            held, place = h[new], np.nonzero(new)[0]
            first = np.nonzero(np.concatenate([[True], held[1:] != held[:-1]]))[0] if len(held) else place
            u, at, n = held[first], place[first], np.diff(np.append(first, len(held)))
            term = [codes[s : s + k].astype("<u4").tobytes().decode("utf-32-le", "replace") for s, k in zip(start[at], length[at])]
            # the row without a term counts the texts
            yield pd.DataFrame({"h": np.append(u, 0), "term": [*term, ""], "df": np.append(n, len(p))})

    counted = cut(rows.mapInPandas(count, "h bigint, term string, df bigint").groupBy("h").agg(F.min("term").alias("term"), F.sum("df").alias("df")).where(F.col("df") >= least))
    n = counted.where("term = ''").agg(F.sum("df")).first()[0] or 0
    kept = counted.where((F.col("term") != "") & (F.col("df") >= rare * n) & (F.col("df") <= max(least, most * n)))
    return kept.orderBy(F.desc("df"), "term").toPandas()


def encode(rows: DataFrame, vocab: pd.DataFrame) -> DataFrame:
    """(doc_id, n_sentences, terms, sizes) of rows (doc_id, text): numbers of the known terms, the number of terms in each sentence that has one, and how many sentences have any term at all."""
    known = vocab["h"].to_numpy()
    order = np.argsort(known)
    sorted_known = known[order]
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, n_sentences int, terms array<int>, sizes array<int>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            h, doc, sentence, *_ = _terms(p["text"].tolist())
            m = len(p)
            if not len(h) or not len(known):
                yield pd.DataFrame({"doc_id": p["doc_id"], "n_sentences": 0, "terms": [[]] * m, "sizes": [[]] * m})
                continue
            first = np.ones(len(h), bool)
            first[1:] = sentence[1:] != sentence[:-1]
            total = np.bincount(doc[first], minlength=m)
            at = np.minimum(np.searchsorted(sorted_known, h), len(known) - 1)
            hit = sorted_known[at] == h
            ids, d, s = order[at[hit]].astype(np.int32), doc[hit], sentence[hit]
            begin = np.nonzero(np.concatenate([[True], s[1:] != s[:-1]]))[0] if len(s) else np.empty(0, np.int64)
            n, owner = np.diff(np.append(begin, len(s))), d[begin]
            bounds, cuts = np.searchsorted(d, np.arange(m + 1)), np.searchsorted(owner, np.arange(m + 1))
            yield pd.DataFrame({
                "doc_id": p["doc_id"].to_numpy(),
                "n_sentences": total,
                "terms": [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])],
                "sizes": [n[a:b].astype(np.int32) for a, b in zip(cuts[:-1], cuts[1:])],
            })

    return rows.mapInPandas(run, schema)


def _digamma(x: np.ndarray) -> np.ndarray:
    out = np.zeros_like(x)
    x = x.copy()
    while (small := x < 6).any():
        out -= np.where(small, 1 / x, 0)
        x = np.where(small, x + 1, x)
    f = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f / 252))


def _infer(p: pd.DataFrame, log_beta: np.ndarray, alpha: float, steps: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(term, sentence of each term, text of each sentence, topic weights of each sentence) of an encoded batch."""
    sizes = np.concatenate([*p["sizes"], np.empty(0, np.int64)]).astype(np.int64)
    terms = np.concatenate([*p["terms"], np.empty(0, np.int64)]).astype(np.int64)
    owner = np.repeat(np.arange(len(p)), [len(x) for x in p["sizes"]])
    k = log_beta.shape[1]
    if not len(sizes):
        return terms, terms, owner, np.empty((0, k))
    fit = np.add.reduceat(log_beta[terms], np.cumsum(sizes) - sizes, axis=0)
    heads = np.nonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))[0]
    gamma = np.full((len(p), k), alpha + 1)
    for _ in range(steps):
        q = fit + _digamma(gamma).astype(np.float32)[owner]
        q = np.exp(q - q.max(1, keepdims=True))
        q /= q.sum(1, keepdims=True)
        gamma[:] = alpha
        gamma[owner[heads]] += np.add.reduceat(q, heads, axis=0)
    return terms, np.repeat(np.arange(len(sizes)), sizes), owner, q


#: Parts of a sum that one task adds up.
FAN_IN = 32


def _summed(parts: DataFrame, tasks: int, k: int, v: int) -> np.ndarray:
    """The sum of parts (row int, sums array<double>), one for each row and task, as a matrix of k rows of v; added up in as many rounds as it takes for no task to hold more than FAN_IN parts of a row."""

    def add(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"row": [key[0]], "slot": [key[1]], "sums": [np.sum(np.stack(p["sums"].to_numpy()), axis=0)]})

    left = parts.withColumn("slot", F.spark_partition_id())
    while tasks > 1:
        left = left.withColumn("slot", F.floor(F.col("slot") / FAN_IN).cast("int")).groupBy("row", "slot").applyInPandas(add, "row int, slot int, sums array<double>")
        tasks = -(-tasks // FAN_IN)
    out = np.zeros((k, v))
    for r in left.toLocalIterator():
        out[r["row"]] += r["sums"]
    return out


class Model:
    """Topics over a vocabulary and the area that each belongs to."""

    def __init__(self, vocab: pd.DataFrame, areas: list[str], log_beta: np.ndarray, area_of: list[int], top: list[list[str]]):
        self.vocab, self.areas, self.log_beta, self.area_of, self.top = vocab, areas, log_beta, area_of, top


def _expected(lam: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray((_digamma(lam) - _digamma(lam.sum(1, keepdims=True))).T, dtype=np.float32)


def fit(coded: DataFrame, labels: DataFrame, vocab: pd.DataFrame, areas: list[str], free: int = 1, passes: int = 3, alpha: float = 0.1, eta: float = 0.05, seed: int = 3) -> Model:
    """The model of encoded documents, guided by labels (doc_id, area); repeated labels count once, labels of other areas not at all."""
    v, k = len(vocab), len(areas) + free
    number = F.create_map(*[x for i, a in enumerate(areas) for x in (F.lit(a), F.lit(i))]) if areas else None
    marked = labels.where(F.col("area").isin(areas)).select("doc_id", F.try_element_at(number, F.col("area")).alias("row")).distinct() if areas else None

    def label_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((len(areas), v))
        for p in batches:
            for row, terms in zip(p["row"], p["terms"]):
                sums[row] += np.bincount(terms, minlength=v)
        yield pd.DataFrame({"row": np.arange(len(areas)), "sums": list(sums)})

    tasks = coded._jdf.rdd().getNumPartitions()
    shuffled = max(tasks, int(coded.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    seen = _summed(coded.select("doc_id", "terms").join(marked, "doc_id").select("row", "terms").mapInPandas(label_counts, "row int, sums array<double>"), shuffled, len(areas), v) if areas else np.zeros((0, v))
    rng = np.random.default_rng(seed)
    df = vocab["df"].to_numpy(float)
    common = df / df.sum()
    by_area = (seen + 2.0 * common) / (seen.sum(1, keepdims=True) + 2.0)
    overall = (seen.sum(0) + 2.0 * common) / (seen.sum() + 2.0)
    lift = by_area / overall
    other = np.stack([np.delete(by_area, i, axis=0).max(0, initial=0.0) for i in range(len(areas))]) if len(areas) > 1 else np.zeros_like(by_area)
    # with few areas a term cannot stand out by much
    stands_out = (lift > min(2.0, 1 + 0.25 * (len(areas) - 1))) & (by_area > 1.5 * other)
    lam = np.empty((k, v))
    scale = df.sum() / k
    lam[: len(areas)] = eta + scale * by_area * np.where(stands_out, 1.0, 0.3)
    quiet = np.where(stands_out.any(0), 0.05, 1.0) * common
    lam[len(areas) :] = eta + scale * quiet * rng.gamma(2.0, 0.5, (free, v))

    for _ in range(passes):
        log_beta = _expected(lam)

        def learn(batches: Iterator[pd.DataFrame], log_beta: np.ndarray = log_beta) -> Iterator[pd.DataFrame]:
            sums = np.zeros((k, v))
            for p in batches:
                terms, sentence, _, q = _infer(p, log_beta, alpha)
                # a topic counts where it can be seen at all; most sentences have one
                for i in range(k):
                    part = q[:, i]
                    some = (part > 1e-4)[sentence]
                    sums[i] += np.bincount(terms[some], weights=part[sentence[some]], minlength=v)
            yield pd.DataFrame({"row": np.arange(k), "sums": list(sums)})

        lam = eta + _summed(coded.select("terms", "sizes").mapInPandas(learn, "row int, sums array<double>"), tasks, k, v)
    beta = lam / lam.sum(1, keepdims=True)
    base = lam.sum(0) / lam.sum()
    weight = beta * np.log(beta / base)
    top = np.argsort(-weight, axis=1)[:, :30]
    area_of = []
    for i in range(k):
        votes = np.zeros(len(areas) + 1)
        for t in top[i]:
            best = int(lift[:, t].argmax()) if len(areas) else -1
            votes[best if len(areas) and seen[:, t].sum() >= 2 and stands_out[best, t] else -1] += weight[i, t]
        area_of.append(int(votes[:-1].argmax()) if votes[:-1].size and votes[:-1].max() > 0.4 * votes.sum() else -1)
    words = vocab["term"].to_numpy()
    return Model(vocab, areas, _expected(lam), area_of, [[str(words[t]) for t in row] for row in top])


def shares(coded: DataFrame, model: Model, alpha: float = 0.1) -> DataFrame:
    """(doc_id, area, share): for each document and area with any of it the part of the document's sentences that belongs to the area."""
    of = np.array(model.area_of)
    log_beta, areas = model.log_beta, np.array(model.areas, dtype=object)
    schema = f"doc_id {dict(coded.dtypes)['doc_id']}, area string, share double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            _, _, owner, q = _infer(p, log_beta, alpha)
            total = np.zeros((len(p), len(areas)))
            for t, a in enumerate(of):
                if a >= 0:
                    total[:, a] += np.bincount(owner, weights=q[:, t], minlength=len(p))
            part = total / np.maximum(p["n_sentences"].to_numpy(), 1)[:, None]
            d, a = np.nonzero(part >= 0.005)
            yield pd.DataFrame({"doc_id": p["doc_id"].to_numpy()[d], "area": areas[a], "share": np.round(part[d, a], 6)})

    return coded.mapInPandas(run, schema)


def area_shares(documents: DataFrame, areas: DataFrame, labels: DataFrame, least: int = 4, rare: float = 2e-5, most: float = 0.3, **model) -> DataFrame:
    """(doc_id, area, share) of documents (doc_id, text): the part of each document's sentences in each of areas (area), learned with labels (doc_id, area).

    Null and empty texts have no row; nor have texts without a known term.
    Of a repeated doc_id every row is assigned. An empty table of areas gives
    an empty result.
    """
    names = sorted(r["area"] for r in areas.where("area is not null").select("area").distinct().toLocalIterator())
    rows = documents.select("doc_id", "text").where("doc_id is not null and text <> ''")
    vocab = vocabulary(rows.select("text"), least, rare, most)
    coded = cut(encode(rows, vocab))
    if not names or not len(vocab):
        return documents.sparkSession.createDataFrame([], f"doc_id {dict(documents.dtypes)['doc_id']}, area string, share double")
    return shares(coded, fit(coded, labels, vocab, names, **model))
