"""Subject areas of documents by a distributed latent Dirichlet topic model.

Sentences are the model's units: each is a mixture of one topic for each subject area and BACKGROUND topics
for what belongs to none, with a Dirichlet prior that leans to the background. Raters' labels only seed the
topics: they give the first topics, and counts of terms that stay in the topics' Dirichlet prior. From there
on the topics are free: expectation passes run over all documents, labelled or not, on the executors
(numpy on Arrow batches), and the maximisation sums one row for each of at most 2^HASH_BITS hashed terms
(words and pairs of neighbouring words), so model and broadcasts have a fixed size. Passes end when the topics move by less than
SETTLED of their weight.

After the fit each topic, background ones too, is mapped to the subject that raters gave to the documents
in which the topic's top terms occur, or to none (``topic_subjects``), so a topic that drifted is caught. A sentence's proportion of
a subject is its expected words from topics of that subject, against those from all subjects and one word
of doubt; a document treats a subject if one of its sentences has a proportion over the cut, which is
fitted to the labelled documents. One word (or compound) in a sentence about something else is a passing
mention and stays under it.

The labels are a bounded sample of documents (LABELLED at most, picked by a hash of the id).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.scale import materialize

HASH_BITS = 18
BACKGROUND = 4
#: Passes at most, the change of the topics that ends them, rounds of a sentence's mixture in a pass.
PASSES, SETTLED, INNER = 8, 0.02, 4
LABELLED = 50_000
#: Dirichlet priors: of a topic's terms; of a subject and of a background topic in a sentence.
ETA, SUBJECT, NEUTRAL = 0.01, 0.02, 4.0
#: How much the labels' counts of a term weigh in the prior of the topics' terms.
SEED = 100.0
#: Labelled documents with a term that weigh as much as knowing nothing about it, and how far the first
#: topics of subjects have a term that raters never saw.
KNOWN, UNSEEN = 0.01, 0.005
#: How far (0 alike, 1 only there) the top terms of a topic have to be tied to a subject to map it.
MAPPED = 0.5
#: Expected words of no subject in a sentence's proportions, and the cuts that are tried.
DOUBT = 1.0
CUTS = tuple(round(0.3 + 0.02 * i, 2) for i in range(26))

_SENTENCE = re.compile(r"[.!?…]+(?=\s|$)|\n+")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_TOKEN = re.compile(f"{_WORD.pattern}|{_SENTENCE.pattern}")


def sentence_words(text: str) -> list[list[str]]:
    """Lower-case words of each sentence; numbers are left out."""
    return [w for s in _SENTENCE.split(text.lower()) if (w := _WORD.findall(s))]


def _encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Word and word-pair buckets of each document, and the number of words of each sentence.

    Pairs start at their first word; the last word of a sentence has -1.
    """
    memo: dict[str, int] = {}
    mask = (1 << HASH_BITS) - 1

    def of(token: str) -> int:
        if token not in memo:
            if len(memo) > 500_000:
                memo.clear()
            memo[token] = xxhash.xxh32_intdigest(token) if _WORD.match(token) else -1
        return memo[token]

    for b in batches:
        docs = [[of(t) for t in _TOKEN.findall(text.lower())] for text in b["text"]]
        uni, bi, ends = [], [], []
        for ids in docs:
            h = np.array([*ids, -1], np.int64)
            last = np.append(h[1:] < 0, True)[h >= 0]
            bounds = np.cumsum(h >= 0)[h < 0]
            h = h[h >= 0]
            pair = (h * 0x9E3779B1 + np.append(h[1:], 0) * 0x85EBCA77) & 0xFFFFFFFF
            pair = ((pair ^ (pair >> 15)) * 0x2C1B3C6D & 0xFFFFFFFF) >> 12 & mask
            uni.append((h & mask).astype(np.int32))
            bi.append(np.where(last, -1, pair).astype(np.int32))
            n = np.diff(bounds, prepend=0)
            ends.append(n[n > 0].astype(np.int32))
        yield pd.DataFrame({"doc_id": b["doc_id"], "votes": b["votes"], "uni": uni, "bi": bi, "ends": ends})


ENCODED = "doc_id bigint, votes array<float>, uni array<int>, bi array<int>, ends array<int>"


class _Batch:
    """The tokens of some documents, sentence by sentence: words and word pairs side by side."""

    def __init__(self, b: pd.DataFrame, k: int):
        lengths = [np.asarray(e, np.int64) for e in b["ends"]]
        self.sent_doc = np.repeat(np.arange(len(b)), [len(e) for e in lengths])
        words = np.concatenate(lengths)
        sent = np.repeat(np.arange(len(words)), words)
        uni = np.concatenate([np.asarray(u, np.int64) for u in b["uni"]])
        bi = np.concatenate([np.asarray(u, np.int64) for u in b["bi"]])
        # a word and the pair that it begins stand together, so that sentences stay in one piece
        both = np.stack([uni, bi], 1).ravel()
        there = both >= 0
        self.term, self.sent = both[there], np.repeat(sent, 2)[there]
        self.is_word = np.tile([True, False], len(uni))[there]
        self.starts = np.searchsorted(self.sent, np.arange(len(words)))
        self.prior = np.full(k, SUBJECT, np.float32)
        self.prior[k - BACKGROUND :] = NEUTRAL

    def responsibilities(self, phi: np.ndarray) -> np.ndarray:
        """[tokens, topics]: variational expectation with sentence mixtures."""
        p, ones = phi[self.term], np.ones(phi.shape[1], np.float32)
        mixed = self.prior * p
        r = mixed * (1 / (mixed @ ones))[:, None]
        for _ in range(INNER - 1):
            theta = self.prior + np.add.reduceat(r, self.starts, axis=0)
            r = theta[self.sent]
            r *= p
            r *= (1 / (r @ ones))[:, None]  # a product sums short rows faster than sum(1)
        return r


def _batches(b: pd.DataFrame, k: int, most: int = 50_000) -> Iterator[tuple[pd.DataFrame, _Batch]]:
    """Parts of about ``most`` words at the most (a longer document is a part of its own)."""
    at = np.cumsum([len(u) for u in b["uni"]]) // most
    for _, part in b.groupby(at, sort=False):
        if sum(len(u) for u in part["uni"]):
            yield part, _Batch(part, k)


def _expect(phi, k: int):
    """mapInPandas function: expected counts of each term in each topic, summed over the batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for _, x in _batches(b, k):
                r = x.responsibilities(phi.value)
                order = np.argsort(x.term, kind="stable")
                terms, first = np.unique(x.term[order], return_index=True)
                sums = np.add.reduceat(r[order], first, axis=0).astype(np.float32)
                yield pd.DataFrame({"term": terms, **{f"t{j}": sums[:, j] for j in range(k)}})

    return run


def _label_counts(batches: Iterator[pd.DataFrame], k: int, subjects: int) -> Iterator[pd.DataFrame]:
    """Seeds: how many words of documents with each subject are each term; the last topics count all."""
    for b in batches:
        for part, x in _batches(b, k):
            votes = np.zeros((len(part), k), np.float32)
            for i, v in enumerate(part["votes"]):
                if v is not None:
                    votes[i, :subjects] = v
            votes[:, k - 1] = 1.0
            votes[:, k - 2] = [v is not None for v in part["votes"]]
            # a long document says little about each of its words
            size = np.maximum(np.array([len(u) for u in part["uni"]], np.float32), 1)
            votes[:, :subjects] /= np.sqrt(size)[:, None]
            votes[:, k - 2] /= np.sqrt(size)
            r = votes[x.sent_doc[x.sent]]
            order = np.argsort(x.term, kind="stable")
            terms, first = np.unique(x.term[order], return_index=True)
            sums = np.add.reduceat(r[order], first, axis=0)
            yield pd.DataFrame({"term": terms, **{f"t{j}": sums[:, j] for j in range(k)}})


def _summed(counts: DataFrame, k: int) -> np.ndarray:
    """[2^HASH_BITS, k]: a row for each term, summed on the executors first."""
    t = counts.groupBy("term").agg(*[F.sum(f"t{j}").cast("float").alias(f"t{j}") for j in range(k)]).toArrow()
    out = np.zeros((1 << HASH_BITS, k), np.float32)
    out[t.column("term").to_numpy()] = np.stack([t.column(f"t{j}").to_numpy() for j in range(k)], 1) if t.num_rows else 0
    return out


def _lift(counts: np.ndarray, subjects: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """([terms, subjects] in 0..1, labelled): how far raters' documents tie a term to a subject, and how much was seen of it.

    A term in documents of all subjects alike (stock phrases) is tied to none.
    """
    labelled = counts[:, k - 2]
    share = counts[:, :subjects].sum(0) / max(labelled.sum(), 1e-9)
    p = (counts[:, :subjects] + share * 0.5) / (labelled + 0.5)[:, None]
    lift = np.log(np.maximum(p, 1e-9) / np.maximum(share, 1e-9)) / np.log(1 / np.clip(share, 1e-3, 0.5))
    return np.clip(lift, 0, 1) ** 2, labelled


def _seeded(counts: np.ndarray, subjects: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(first topics, prior counts): terms by what raters tie to a subject, background by the rest.

    Terms that raters never saw are background at first and have no prior counts.
    """
    lift, labelled = _lift(counts, subjects, k)
    seen, all_words = (labelled > 0)[:, None], counts[:, k - 1]
    allowed = np.where(seen, (KNOWN + labelled[:, None] * lift) / (KNOWN + labelled[:, None]), UNSEEN)
    rest = np.maximum(1 - allowed.max(1, initial=0), UNSEEN)
    first, prior = np.zeros((len(counts), k)), np.zeros((len(counts), k), np.float32)
    first[:, :subjects] = allowed * all_words[:, None]
    first[:, subjects:] = (rest * all_words)[:, None] * np.random.default_rng(11).uniform(0.8, 1.2, (len(counts), k - subjects))
    prior[:, :subjects] = SEED * lift * labelled[:, None]
    prior[:, subjects:] = (SEED * (1 - lift.max(1, initial=0)) * labelled / (k - subjects))[:, None]
    return _normal(first), prior


def _normal(counts: np.ndarray) -> np.ndarray:
    smooth = counts + ETA
    return (smooth / smooth.sum(0)).astype(np.float32)


class Topics:
    """A fitted model: term probabilities [2^HASH_BITS, topics], the subject of each topic or None, the cut, passes run."""

    def __init__(self, phi: np.ndarray, mapping: list[str | None], cut: float = 0.5, passes: int = 0):
        self.phi, self.mapping, self.cut, self.passes = phi, mapping, cut, passes


def label_votes(labels: DataFrame, subjects: list[str]) -> DataFrame:
    """(doc_id, votes): the part of a document's raters that gave each subject; ``none`` gives zeros.

    Repeated rows count once; names are read without regard to case and outer spaces; unknown
    subjects and null ids are left out. At most about LABELLED documents, picked by a hash of the id.
    """
    s = F.lower(F.trim("subject"))
    r = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), s.alias("s"), F.coalesce("rater", F.lit("")).alias("rater")).where(F.col("doc_id").isNotNull() & F.col("s").isin(*subjects, "none")).distinct()
    v = r.groupBy("doc_id").agg(F.count_distinct("rater").alias("n"), *[F.count_distinct(F.when(F.col("s") == x, F.col("rater"))).alias(f"v{i}") for i, x in enumerate(subjects)])
    n = v.count()
    keep = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(min(1.0, LABELLED / max(n, 1)) * (1 << 20))
    return v.where(keep).select("doc_id", F.array(*[(F.col(f"v{i}") / F.col("n")).cast("float") for i in range(len(subjects))]).alias("votes"))


def encode(documents: DataFrame, votes: DataFrame | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents as hashed terms, written once; null ids and null texts are left out."""
    if votes is None:
        votes = documents.sparkSession.createDataFrame([], "doc_id bigint, votes array<float>")
    d = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    return materialize(d.join(votes, "doc_id", "left").mapInPandas(_encoded, ENCODED))


def fit(encoded: DataFrame, subjects: list[str], passes: int = PASSES, judged: DataFrame | None = None) -> Topics:
    """Fit the topics on all of ``encoded``, map them to subjects and fit the cut to the labelled documents.

    ``judged`` has the texts that the raters read, if ``encoded`` has others as well.
    """
    n, k = len(subjects), len(subjects) + BACKGROUND
    sc = encoded.sparkSession.sparkContext
    ddl = "term int, " + ", ".join(f"t{j} float" for j in range(k))
    counts = _summed(encoded.mapInPandas(lambda it: _label_counts(it, k, n), ddl), k)
    phi, prior = _seeded(counts, n, k)
    before, ran = np.zeros_like(prior), 0
    for ran in range(1, passes + 1):
        shared = sc.broadcast(phi)
        held = _summed(encoded.mapInPandas(_expect(shared, k), ddl), k)
        phi = _normal(held + prior)
        shared.unpersist()
        moved = np.abs(held[:, :n] - before[:, :n]).sum() / max(held[:, :n].sum(), 1e-9)
        before = held
        if moved < SETTLED:
            break
    topics = Topics(phi, topic_subjects(phi, counts, subjects), passes=ran)
    topics.cut = _fitted_cut((encoded if judged is None else judged).where("votes IS NOT NULL"), topics, subjects)
    return topics


def topic_subjects(phi: np.ndarray, label_counts: np.ndarray, subjects: list[str], terms: int = 50) -> list[str | None]:
    """The subject of each topic by its top terms: what raters gave to the documents that have them.

    A topic's top terms are those it holds most of. A topic is of no subject if its terms occur in
    documents of all subjects alike; a topic none of whose terms raters saw stays what it was seeded as.
    """
    n, k = len(subjects), phi.shape[1]
    share = label_counts[:, :n].sum(0) / max(label_counts[:, k - 2].sum(), 1e-9)
    held = phi / phi.sum(1, keepdims=True)
    out: list[str | None] = []
    for j in range(k):
        own = held[:, j] > 0.5
        top = np.argsort(-np.where(own, phi[:, j], 0))[: min(terms, int(own.sum()))]
        seen = label_counts[top, k - 2].sum()
        if not seen:
            out.append(subjects[j] if j < n else None)
            continue
        p = label_counts[top, :n].sum(0) / seen
        lift = np.log(np.maximum(p, 1e-9) / np.maximum(share, 1e-9)) / np.log(1 / np.clip(share, 1e-3, 0.5))
        out.append(subjects[int(lift.argmax())] if lift.max() > MAPPED else None)
    return out


def _proportions(model, mapping: list[str | None], subjects: list[str]):
    """mapInPandas function: (doc_id, subject, proportion, words, of) of each sentence and subject that may count.

    ``words`` are the sentence's, ``of`` the document's.
    """
    k = len(mapping)
    to = np.zeros((k, len(subjects)), np.float32)
    for j, subject in enumerate(mapping):
        if subject is not None:
            to[j, subjects.index(subject)] = 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part, x in _batches(b, k):
                r = x.responsibilities(model.value)[x.is_word] @ to
                sent = x.sent[x.is_word]
                words = np.bincount(sent, minlength=len(x.sent_doc))
                expected = np.add.reduceat(r, np.searchsorted(sent, np.arange(len(x.sent_doc))), axis=0)
                share = expected / (expected.sum(1, keepdims=True) + DOUBT)
                at, j = np.nonzero(share >= CUTS[0])
                of = np.bincount(x.sent_doc, words, len(part)).astype(np.int64)
                doc = x.sent_doc[at]
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy()[doc], "subject": np.array(subjects, object)[j], "proportion": share[at, j].astype(np.float64), "words": words[at], "of": of[doc]})

    return run


PROPORTIONS = "doc_id bigint, subject string, proportion double, words bigint, of bigint"


def _fitted_cut(labelled: DataFrame, topics: Topics, subjects: list[str]) -> float:
    """The cut at which the labelled documents agree best (F1) with the majority of their raters.

    Only one row for each cut reaches the driver. Without labels it is the middle one.
    """
    model = labelled.sparkSession.sparkContext.broadcast(topics.phi)
    got = labelled.mapInPandas(_proportions(model, topics.mapping, subjects), PROPORTIONS).groupBy("doc_id", "subject").agg(F.max("proportion").alias("p"))
    want = labelled.groupBy("doc_id").agg(F.first("votes").alias("v")).select("doc_id", F.explode(F.arrays_zip(F.array(*[F.lit(s) for s in subjects]).alias("subject"), F.col("v").alias("vote"))).alias("x"))
    want = want.select("doc_id", F.col("x.subject").alias("subject"), (F.col("x.vote") > 0.5).alias("y"))
    j = want.join(got, ["doc_id", "subject"], "left").select("y", F.coalesce("p", F.lit(0.0)).alias("p"))
    counts = j.agg(F.count_if("y").alias("n"), *[x for i, c in enumerate(CUTS) for x in (F.count_if(F.col("p") >= c).alias(f"m{i}"), F.count_if((F.col("p") >= c) & F.col("y")).alias(f"h{i}"))]).first()
    if not counts["n"]:
        return CUTS[len(CUTS) // 2]
    f1 = np.array([2 * counts[f"h{i}"] / max(counts[f"m{i}"] + counts["n"], 1) for i in range(len(CUTS))])
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    return CUTS[int(best[len(best) // 2])]


def assign(encoded: DataFrame, topics: Topics, subjects: list[str]) -> DataFrame:
    """(doc_id, subject, sentences, share): a row for each subject that a document treats.

    sentences counts those that treat the subject, share is their part of the document's words.
    Documents without any subject have no row; labels are not used here.
    """
    model = encoded.sparkSession.sparkContext.broadcast(topics.phi)
    rows = encoded.mapInPandas(_proportions(model, topics.mapping, subjects), PROPORTIONS).where(F.col("proportion") >= topics.cut)
    return rows.groupBy("doc_id", "subject").agg(F.count(F.lit(1)).alias("sentences"), F.sum(F.col("words") / F.col("of")).alias("share"))


def document_subjects(documents: DataFrame, labels: DataFrame, areas: DataFrame) -> DataFrame:
    """Fit on all documents and assign their subjects; ``areas`` (subject, ..) is the list of subjects."""
    subjects = sorted(r["s"] for r in areas.select(F.lower(F.trim("subject")).alias("s")).where("s IS NOT NULL").distinct().collect())
    votes = label_votes(labels, subjects)
    enc = encode(documents, votes)
    # the other side of a segment pair says mostly the same in another language: more to learn words from
    other = encode(documents, votes, text_col="target_text") if "target_text" in documents.columns else None
    return assign(enc, fit(enc if other is None else enc.unionByName(other), subjects, judged=enc), subjects)


def composition(assigned: DataFrame, documents: DataFrame, areas: DataFrame) -> DataFrame:
    """(subject, documents, words, word_share, target_share): the corpus by subject, against its targets."""
    words = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.size(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]+"), F.lit(0))).alias("w"))
    by = assigned.join(words, "doc_id").groupBy("subject").agg(F.count_distinct("doc_id").alias("documents"), F.round(F.sum(F.col("share") * F.col("w"))).cast("bigint").alias("words"))
    t = areas.select(F.lower(F.trim("subject")).alias("subject"), "target_share").join(by, "subject", "left").fillna(0, ["documents", "words"])
    # a row for each subject
    return t.withColumn("total", F.sum("words").over(Window.partitionBy())).select("subject", "documents", "words", F.round(F.col("words") / F.col("total"), 6).alias("word_share"), "target_share")
