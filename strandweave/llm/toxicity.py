"""Toxicity by weak supervision.

Voters are words of a fixed lexicon, word stems that the labelled sample shows in toxic
texts or in other texts only, and patterns. Each votes for one class or abstains. A
generative label model has a kind for each document, one of several toxic kinds (groups
of voters that go together, as those of one language do) or none, and within a kind
voters that depend on one another along a tree. Shares and firing rates maximise one
objective by expectation maximisation: the log likelihood of the votes on all documents plus
the log density of an anchor, pseudo-counts at the rates that the labelled sample shows, as
many as each toxic kind is expected to have documents; it rises in every round until it settles. No label enters but
through the choice of stems, the starting point, the anchor and the share of toxic texts. The model's posterior labels, on a
bounded sample of documents, train a linear classifier on the presence of words and stems.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BoundedCache, fold, stored, whole_text
from .labelled import labelled_sample, texts_of

# Insulting words, one voter each.
LEXICON = (
    "idiot", "moron", "stupid", "trash", "pathetic", "worthless", "disgusting", "scum",
    "loser", "clown", "dumb", "filthy", "vermin", "garbage", "hate", "kill",
)
#: Pattern voters for toxic texts: shouting, runs of capitals, stretched letters, letters hidden by stars.
TOXIC_PATTERNS = (re.compile(r"!{2,}"), re.compile(r"\b[A-Z]{4,}\b"), re.compile(r"([^\W\d_])\1{3,}"), re.compile(r"[^\W\d_]\*+[^\W\d_]"))
#: Pattern voters for other texts: licences and rights, addresses of pages, quantities.
CLEAN_PATTERNS = (re.compile(r"\b(?:[Ll]icense|[Cc]opyright|[Rr]ights reserved)"), re.compile(r"https?://"), re.compile(r"\b[0-9]+(?:[.,][0-9]+)? ?(?:%|kg|km|cm|EUR|USD)"))
#: What a word has of each pattern above that reaches over a space.
HINTS = (r"[Ll]icense|[Cc]opyright|[Rr]ights", r"[0-9]")
#: What every word has that one of the patterns or hints matches.
NOTABLE = re.compile(r"!!|[A-Z]{4}|\*|[0-9]|http|icense|opyright|ights|([^\W\d_])\1{3}")
#: Stem voters for toxic and for other texts. All voters of a text are bits of one 64-bit number.
STEM_VOTERS, CLEAN_STEM_VOTERS = 26, 10
#: Of the former so many may be stems that a text shows in at least REPEATED words.
REPEATED_STEM_VOTERS, REPEATED = 12, 3
VOTERS = len(LEXICON) + STEM_VOTERS + len(TOXIC_PATTERNS) + CLEAN_STEM_VOTERS + len(CLEAN_PATTERNS)
#: The first voters speak for toxic texts, the others against.
TOXIC_VOTERS = len(LEXICON) + STEM_VOTERS + len(TOXIC_PATTERNS)
STEM_LENGTHS = (3, 4, 5, 6, 7, 8)
#: Stems are chosen from at most so many labelled rows of each class.
SAMPLE_A_CLASS = 4_000
#: The classifier is fitted on posterior labels of at most so many documents on either side of one half, none of the held-out fold.
POSTERIORS_A_SIDE = 4_000
#: Words and stems that the classifier weighs, and the least number of toxic sample texts that a stem voter needs.
FEATURES, LEAST_TEXTS = 1024, 5
#: How many standard errors its log odds must be above 0: in a small sample many stems are in toxic texts only by chance.
LEAST_Z = 3.2
#: Expectation maximisation ends when a round adds less than SETTLED times the documents to the objective, the search for the tree when it doesn't change.
MOST_ROUNDS, SETTLED, MOST_TREES = 100, 1e-6, 4
#: Pseudo-count of each firing rate.
PSEUDO = 2.0
#: Pseudo-texts of a toxic kind at the rates that it started with, as a share of the texts that it is expected to have: a small kind would wander off to whatever texts are many.
ANCHOR = 0.5
#: Distinct masks that are kept on the driver between rounds; more are summed by Spark in each round. The sums are the same.
MASKS_AT_HAND = 50_000
#: Two voters go together if they fire on so many toxic sample texts at once, and so many times as often as by chance; how many groups make kinds.
LEAST_TOGETHER, LIFT, MOST_KINDS = 3, 1.5, 8
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
EDGES = ".,;:!?\"'()[]{}<>|*&$#%-_/\\"


def names_of(word: str) -> list[str]:
    """The features of a word: itself and its stems."""
    core = word.strip(EDGES).lower()
    return [f"={core}", *(core[:n] for n in STEM_LENGTHS if len(core) > n)] if core else []


def names_in(text: str) -> set[str]:
    """The features of a text: those of its words, and "+" before a stem that at least REPEATED different words have."""
    counts = Counter(name for word in set(text.split()) for name in names_of(word))
    return {*counts, *(f"+{name}" for name, n in counts.items() if n >= REPEATED and name[0] != "=")}


@dataclass
class Voters:
    stems: list[str] = field(default_factory=list)
    clean_stems: list[str] = field(default_factory=list)

    def prepare(self) -> None:
        self.bits = {f"={w}": 1 << i for i, w in enumerate(LEXICON)}
        for first, names in ((len(LEXICON), self.stems), (TOXIC_VOTERS, self.clean_stems)):
            for i, stem in enumerate(names):
                self.bits[stem] = self.bits.get(stem, 0) | 1 << (first + i)
        # A word of a repeated stem has the stem's vote 64 bits higher, where it is counted.
        self.bits |= {name[1:]: self.bits.get(name[1:], 0) | bit << 64 for name, bit in list(self.bits.items()) if name[0] == "+"}
        toxic_at, clean_at = len(LEXICON) + STEM_VOTERS, TOXIC_VOTERS + CLEAN_STEM_VOTERS
        patterns = [(p, 1 << (toxic_at + i)) for i, p in enumerate(TOXIC_PATTERNS)] + [(p, 1 << (clean_at + i)) for i, p in enumerate(CLEAN_PATTERNS)]
        # A pattern without white space is a pattern of words, whose votes are kept; the others wait until a word shows that they may match.
        self.of_words = [(p, bit) for p, bit in patterns if " " not in p.pattern]
        self.of_texts = [(p, bit, 1 << (VOTERS + i)) for i, (p, bit) in enumerate((p, bit) for p, bit in patterns if " " in p.pattern)]
        self.hints = [(re.compile(h), hint) for h, (_, _, hint) in zip(HINTS, self.of_texts, strict=True)]
        self.cache = BoundedCache()

    def of_word(self, word: str) -> int:
        bits = 0
        for name in names_of(word):
            bits |= self.bits.get(name, 0)
        if NOTABLE.search(word):
            for pattern, bit in self.of_words + self.hints:
                if pattern.search(word):
                    bits |= bit
        return bits

    def mask(self, text: str) -> int:
        """The votes on a text as bits."""
        cache, newer, out = self.cache, self.cache.newer, 0
        repeated: list[int] = []
        for word in set(text.split()):
            if (bits := newer.get(word)) is None and (bits := cache.get(word)) is None:
                bits = self.of_word(word)
                cache.keep(word, bits)
                newer = cache.newer
            out |= bits
            if bits >> 64:
                repeated.append(bits >> 64)
        if len(repeated) >= REPEATED:
            for i in range(len(LEXICON), len(LEXICON) + STEM_VOTERS):
                if sum(bits >> i & 1 for bits in repeated) >= REPEATED:
                    out |= 1 << i
        for pattern, bit, hint in self.of_texts:
            if out & hint and pattern.search(text):
                out |= bit
        return out & ((1 << VOTERS) - 1)


def sample_names(sample: DataFrame) -> pd.DataFrame:
    """Names of words and stems with the number of toxic and other sample texts that have them, strongest association first: at most 16 * FEATURES rows."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(name, y) for text, y in zip(pdf["text"], pdf["label"], strict=True) for name in names_in(text)]
            yield pd.DataFrame(rows, columns=["name", "label"])

    counts = (
        sample.select("text", "label")
        .mapInPandas(count, "name string, label int")
        .groupBy("name")
        .agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("other"))
        .where((F.col("toxic") >= 2) | (F.col("other") >= 8))
    )
    sizes = sample.groupBy("label").count().collect()
    n = {r.label: r["count"] for r in sizes}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    odds = F.ln((F.col("toxic") + 0.5) / (n1 + 1.0)) - F.ln((F.col("other") + 0.5) / (n0 + 1.0))
    error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("other") + 0.5))
    return counts.withColumn("z", odds / error).orderBy(F.abs("z").desc(), "name").limit(16 * FEATURES).toPandas()


def stem_voters(names: pd.DataFrame) -> list[str]:
    """Repeated stems, then words and stems, used in toxic texts almost only: of each the shortest, without those that a shorter one covers, most usual first."""
    repeated = names["name"].str.startswith("+")
    found = _covering(names[repeated])[:REPEATED_STEM_VOTERS]
    return found + _covering(names[~repeated])[: STEM_VOTERS - len(found)]


def _covering(names: pd.DataFrame) -> list[str]:
    good = names[(names["toxic"] >= LEAST_TEXTS) & (names["z"] >= LEAST_Z) & (names["other"] <= 0.05 * names["toxic"]) & ~names["name"].isin([f"={w}" for w in LEXICON])]
    picked: list[tuple[int, str]] = []
    order = sorted(zip(good["name"], good["toxic"], strict=True), key=lambda x: (len(x[0].lstrip("=+")), x[0]))
    for name, toxic in order:
        core = name.lstrip("=+")
        if not any(core.startswith(p.lstrip("+")) for _, p in picked if not p.startswith("=")) and core not in LEXICON and not any(w.startswith(core) for w in LEXICON):
            picked.append((int(toxic), name))
    return [name for _, name in sorted(picked, key=lambda x: (-x[0], x[1]))]


def clean_stem_voters(names: pd.DataFrame) -> list[str]:
    """Words and stems that no toxic sample text has, most usual first, without those that a shorter one covers."""
    good = names[(names["toxic"] == 0) & (names["other"] >= 8) & ~names["name"].str.startswith("+")]
    picked: list[str] = []
    for name, _ in sorted(zip(good["name"], good["other"], strict=True), key=lambda x: (-x[1], x[0])):
        core = name.lstrip("=")
        if not any(core.startswith(p.lstrip("=")) or p.lstrip("=").startswith(core) for p in picked):
            picked.append(name)
    return picked[:CLEAN_STEM_VOTERS]


@dataclass
class LabelModel:
    """Shares of the kinds (the first isn't toxic, all others are), and within each kind the chance that a voter fires, given whether its parent in the tree does."""

    shares: np.ndarray  # kinds
    parents: np.ndarray  # voters; -1: none
    rates: np.ndarray  # kinds x parent fires x voters

    @property
    def prior(self) -> float:
        return float(1 - self.shares[0])

    def log_joint(self, bits: np.ndarray) -> np.ndarray:
        """rows x kinds: log of the kind's share and its chance of these votes."""
        given = np.where(self.parents >= 0, bits[:, self.parents], 0).astype(bool)
        out = np.empty((len(bits), len(self.shares)))
        for z, share in enumerate(self.shares):
            p = np.where(given, self.rates[z, 1], self.rates[z, 0])
            out[:, z] = math.log(share) + np.where(bits > 0, np.log(p), np.log1p(-p)).sum(axis=1)
        return out

    def posterior(self, bits: np.ndarray) -> np.ndarray:
        """The chance of any toxic kind."""
        joint = self.log_joint(bits)
        toxic = np.logaddexp.reduce(joint[:, 1:], axis=1)
        return 1 / (1 + np.exp(np.clip(joint[:, 0] - toxic, -30, 30)))


def unpack(masks: np.ndarray, size: int = VOTERS) -> np.ndarray:
    return ((masks[:, None] >> np.arange(size, dtype=np.int64)) & 1).astype(np.float64)


def _moments(pdf: pd.DataFrame, now: LabelModel) -> tuple[np.ndarray, float]:
    size, kinds = len(now.parents), len(now.shares)
    sums, likelihood = np.zeros((kinds, size + 1, size + 1)), 0.0
    for a in range(0, len(pdf), 10_000):
        part = pdf.iloc[a : a + 10_000]
        bits, n = unpack(part["mask"].to_numpy(np.int64), size), part["n"].to_numpy(np.float64)
        joint = now.log_joint(bits)
        whole = np.logaddexp.reduce(joint, axis=1)
        likelihood += float(n @ whole)
        q = np.exp(joint - whole[:, None])
        full = np.hstack([bits, np.ones((len(bits), 1))])
        for z in range(kinds):
            sums[z] += full.T @ (full * (n * q[:, z])[:, None])
    return sums, likelihood


def expected_moments(votes: DataFrame | pd.DataFrame, now: LabelModel) -> tuple[np.ndarray, float]:
    """For each kind the expected sums of products of votes (and of one, in the last row and column), and the log likelihood: one aggregation of fixed size."""
    if isinstance(votes, pd.DataFrame):
        return _moments(votes, now)
    size, kinds = len(now.parents), len(now.shares)

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flat = np.zeros(kinds * (size + 1) ** 2 + 1)
        for pdf in batches:
            sums, likelihood = _moments(pdf, now)
            flat += np.r_[sums.ravel(), likelihood]
        yield pd.DataFrame({"place": np.arange(flat.size), "value": flat})

    found = votes.mapInPandas(moments, "place int, value double").groupBy("place").agg(F.sum("value").alias("value"))
    flat = np.zeros(kinds * (size + 1) ** 2 + 1)
    for r in found.collect():  # kinds x (voters + 1)^2 + 1 rows
        flat[r.place] = r.value
    return flat[:-1].reshape(kinds, size + 1, size + 1), float(flat[-1])


@dataclass
class Anchor:
    """Pseudo-counts that stay the same through all rounds: PSEUDO texts for each rate and ``texts`` texts for each kind, of independent votes at ``rates``."""

    texts: np.ndarray  # kinds
    rates: np.ndarray  # kinds x voters

    @classmethod
    def at(cls, start: LabelModel, n: float) -> Anchor:
        return cls(ANCHOR * n * np.r_[0.0, start.shares[1:]], start.rates[:, 0, :].copy())

    def counts(self, parents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """kinds x parent fires x voters: pseudo-texts in which the voter fires, and all of them. Voters without a parent have theirs in the first place."""
        given = np.where(parents >= 0, self.rates[:, parents], 0.0)
        texts = self.texts[:, None, None] * np.stack([1 - given, given], axis=1)
        texts = texts + np.where(parents >= 0, PSEUDO, np.array([PSEUDO, 0.0])[:, None])
        return texts * self.rates[:, None, :], texts

    def log_density(self, model: LabelModel) -> float:
        """Of the model's rates and of the toxic kinds' shares, but for a constant."""
        fires, texts = self.counts(model.parents)
        return float((fires * np.log(model.rates) + (texts - fires) * np.log1p(-model.rates)).sum() + self.texts[1:] @ np.log(model.shares[1:]))


def maximised(sums: np.ndarray, parents: np.ndarray, toxic_voters: int = TOXIC_VOTERS, prior: float | None = None, anchor: Anchor | None = None) -> LabelModel:
    """The model of greatest objective for these moments and the anchor's pseudo-counts (without one, PSEUDO texts at the rates of all texts) and, where it is given, this share of toxic texts, under the rule that no voter fires more often on the side it speaks against: those against in no toxic kind, those for not in all toxic kinds together."""
    kinds, size = len(sums), len(parents)
    total, alone = sums[:, -1, -1], sums[:, -1, :-1]
    parent, pooled = np.maximum(parents, 0), alone.sum(axis=0) / max(total.sum(), 1e-9)
    if anchor is None:
        anchor = Anchor(np.zeros(kinds), (alone + PSEUDO * pooled) / (total[:, None] + PSEUDO))
    fires, texts = anchor.counts(parents)
    rates = np.empty((kinds, 2, size))
    for z in range(kinds):
        both, of_parent = np.where(parents >= 0, sums[z, parent, np.arange(size)], 0.0), np.where(parents >= 0, alone[z, parent], 0.0)
        rates[z, 1] = (both + fires[z, 1]) / np.maximum(of_parent + texts[z, 1], 1e-9)
        rates[z, 0] = (alone[z] - both + fires[z, 0]) / (total[z] - of_parent + texts[z, 0])
        rates[z, 1, parents < 0] = rates[z, 0, parents < 0]
    mass = anchor.texts + PSEUDO
    overall = (alone + mass[:, None] * anchor.rates) / (total + mass)[:, None]
    toxic = (alone[1:] + mass[1:, None] * anchor.rates[1:]).sum(axis=0) / (total + mass)[1:].sum()
    speaks_for = np.arange(size) < toxic_voters
    rates[:, :, speaks_for & (toxic < overall[0])] = pooled[speaks_for & (toxic < overall[0])]
    for z in range(1, kinds):
        wrong = ~speaks_for & (overall[z] > overall[0])
        rates[z][:, wrong] = overall[0, wrong]
    seen = total + anchor.texts
    shares = np.maximum((seen + 1 / kinds) / (seen.sum() + 1), 1e-5)
    shares /= shares.sum()
    if prior is not None:
        shares = np.r_[1 - prior, prior * shares[1:] / shares[1:].sum()]
    return LabelModel(shares, parents, np.clip(rates, 1e-6, 1 - 1e-6))


def dependence_tree(sums: np.ndarray) -> np.ndarray:
    """Parents of the forest of greatest conditional information between voters, among pairs that depend on each other beyond chance (likelihood ratio at p = 0.001, one degree of freedom a kind)."""
    kinds, size = len(sums), sums.shape[1] - 1
    spread = 2 / (9 * kinds)
    least_ratio = kinds * (1 - spread + 3.09 * math.sqrt(spread)) ** 3
    gain = np.zeros((size, size))
    for z in range(kinds):
        total = max(sums[z, -1, -1], 1e-9)
        a, b = sums[z, -1, :-1][:, None], sums[z, -1, :-1][None, :]
        both = sums[z, :-1, :-1]
        for seen, expected in ((both, a * b), (a - both, a * (total - b)), (b - both, (total - a) * b), (total - a - b + both, (total - a) * (total - b))):
            ok = (seen > 1e-9) & (expected > 1e-9)
            gain += np.where(ok, seen * np.log(np.where(ok, seen * total / np.where(ok, expected, 1), 1)), 0)
    neighbours: list[list[int]] = [[] for _ in range(size)]
    groups = Groups(size)
    pairs = sorted(((-gain[i, j], i, j) for i in range(size) for j in range(i + 1, size) if 2 * gain[i, j] > least_ratio))
    for _, i, j in pairs:
        if groups.join(i, j):
            neighbours[i].append(j)
            neighbours[j].append(i)
    parents, seen_voters = np.full(size, -1), set()
    for start in range(size):
        todo = [(start, -1)] if start not in seen_voters else []
        while todo:
            i, parent = todo.pop()
            seen_voters.add(i)
            parents[i] = parent
            todo += [(j, i) for j in neighbours[i] if j != parent]
    return parents


class Groups:
    """Disjoint sets of a few numbers."""

    def __init__(self, n: int):
        self.root = list(range(n))

    def find(self, i: int) -> int:
        while self.root[i] != i:
            i = self.root[i]
        return i

    def join(self, i: int, j: int) -> bool:
        """Whether they were apart."""
        a, b = self.find(i), self.find(j)
        self.root[max(a, b)] = min(a, b)
        return a != b


def fit_label_model(votes: DataFrame, start: LabelModel, heard: list[float] | None = None) -> LabelModel:
    """The greatest objective for ``votes`` (mask, n) from a starting point, whose share of toxic texts it keeps: for voters that are independent first, then along the tree that the moments ask for.

    The objective is the log likelihood of all votes plus the anchor's log density. A step is
    taken only if it raises the objective: the rule on signs, which isn't part of it, could lower it.
    ``heard`` gets the objective of each step taken, and None where a new tree begins.

    Most texts have no votes, so the votes alone don't tell how many texts are toxic: a
    toxic kind would come to stand for texts without votes.
    """
    sizes = votes.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("masks")).first()
    n = max(1, sizes.n or 0)
    rows = votes.toPandas() if sizes.masks <= MASKS_AT_HAND else votes
    anchor, heard = Anchor.at(start, n), [] if heard is None else heard
    model, best, value, trees = start, None, -math.inf, 0
    for _ in range(MOST_ROUNDS):
        sums, likelihood = expected_moments(rows, model)
        now = likelihood + anchor.log_density(model)
        settled = abs(now - value) < SETTLED * n or now < value
        if now >= value:
            best, value = (model, sums), now
            heard.append(now)
        if settled:
            parents = dependence_tree(best[1])
            if trees == MOST_TREES or (parents == best[0].parents).all():
                break
            trees, value = trees + 1, -math.inf
            heard.append(None)
            model = maximised(best[1], parents, prior=start.prior, anchor=anchor)
        else:
            model = maximised(sums, model.parents, prior=start.prior, anchor=anchor)
    return best[0]


def voter_groups(bits: np.ndarray, n: np.ndarray) -> list[list[int]]:
    """Word and stem voters that go together on toxic sample texts (rows of votes, n times each), the groups with most texts first."""
    words = len(LEXICON) + STEM_VOTERS
    bits = bits[:, :words]
    together = bits.T @ (bits * n[:, None])
    alone, groups = np.diag(together), Groups(words)
    linked = (together >= LEAST_TOGETHER) & (together * n.sum() > LIFT * np.outer(alone, alone))
    for i, j in zip(*np.nonzero(np.triu(linked, 1)), strict=True):
        groups.join(int(i), int(j))
    members: dict[int, list[int]] = {}
    for i in range(words):
        members.setdefault(groups.find(i), []).append(i)
    texts = {g: float(n[bits[:, m].any(axis=1)].sum()) for g, m in members.items()}
    return [members[g] for g in sorted(members, key=lambda g: (-texts[g], g)) if texts[g] >= LEAST_TOGETHER][:MOST_KINDS]


def starting_point(votes: DataFrame, prior: float) -> LabelModel:
    """Independent voters with the rates of the labelled sample's votes (mask, label, n). Toxic texts start in the kind of the group that most of their votes are of, those without any in all kinds alike. Usual rates where the sample is empty."""
    rows = votes.toPandas()  # at most two classes of SAMPLE_A_CLASS texts
    bits, n, toxic = unpack(rows["mask"].to_numpy(np.int64)), rows["n"].to_numpy(np.float64), rows["label"].to_numpy() == 1
    groups = voter_groups(bits[toxic], n[toxic]) or [[]]
    kinds = 1 + len(groups)
    votes_of = np.array([bits[:, g].sum(axis=1) for g in groups]).T
    best = (votes_of == votes_of.max(axis=1, keepdims=True)).astype(np.float64)
    q = np.hstack([np.where(toxic, 0.0, 1.0)[:, None], np.where(toxic[:, None], best / best.sum(axis=1, keepdims=True), 0.0)])
    sums = np.zeros((kinds, VOTERS + 1, VOTERS + 1))
    sums[:, -1, -1] = [1 - prior, *[prior / (kinds - 1)] * (kinds - 1)]
    sums[0, -1, :-1] = np.where(np.arange(VOTERS) < TOXIC_VOTERS, 0.01, 0.1) * (1 - prior)
    sums[1:, -1, :-1] = np.where(np.arange(VOTERS) < TOXIC_VOTERS, 0.1, 0.01) * prior / (kinds - 1)
    sums[:, -1, :-1] += q.T @ (bits * n[:, None])
    sums[:, -1, -1] += q.T @ n
    model = maximised(sums, np.full(VOTERS, -1))
    of_toxic = sums[1:, -1, -1] / sums[1:, -1, -1].sum()
    model.shares = np.r_[1 - prior, prior * of_toxic]
    return model


@dataclass
class ToxicityModel:
    weights: dict[str, float]
    bias: float

    def prepare(self) -> None:
        self.places = {name: i for i, name in enumerate(self.weights)}
        self.values = list(self.weights.values())
        self.cache = BoundedCache()

    def present(self, text: str) -> set[int]:
        """Places of the features that a text has."""
        cache, newer, out = self.cache, self.cache.newer, set()
        repeated: dict[int, int] = {}
        for word in set(text.split()):
            if (found := newer.get(word)) is None and (found := cache.get(word)) is None:
                names = names_of(word)
                found = tuple(self.places[n] for n in names if n in self.places), tuple(self.places[f"+{n}"] for n in names if f"+{n}" in self.places)
                cache.keep(word, found)
                newer = cache.newer
            if found[0]:
                out.update(found[0])
            for i in found[1]:
                repeated[i] = repeated.get(i, 0) + 1
        out.update([i for i, n in repeated.items() if n >= REPEATED])
        return out

    def score(self, text: str) -> float:
        total = self.bias + math.fsum(self.values[i] for i in sorted(self.present(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))


def fit_linear(present: list[np.ndarray], target: np.ndarray, weight: np.ndarray, n_features: int) -> tuple[np.ndarray, float]:
    """Logistic regression with a small ridge on soft targets, by accelerated gradient steps."""
    w, b = np.zeros(n_features), 0.0
    lengths = np.array([len(p) for p in present])
    columns = np.concatenate(present).astype(np.int64) if len(present) else np.zeros(0, np.int64)
    rows = np.repeat(np.arange(len(present)), lengths)
    weight = weight / max(weight.sum(), 1e-12)
    g2w, g2b = np.full(n_features, 1e-8), 1e-8
    for _ in range(300):
        z = b + np.bincount(rows, w[columns], minlength=len(present))
        err = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target)
        gw = np.bincount(columns, err[rows], minlength=n_features) + 1e-4 * w
        gb = err.sum()
        g2w += gw**2
        g2b += gb**2
        w -= 0.5 * gw / np.sqrt(g2w)
        b -= 0.5 * gb / math.sqrt(g2b)
    return w, float(b)


def vote_masks(docs: DataFrame, voters: Voters, *also: str) -> DataFrame:
    """(text_hash, mask, usable) of each document, and the columns named; usable is false in the held-out fold and without an identifier. Null texts count as empty."""
    held = docs.sparkSession.sparkContext.broadcast(voters)

    def vote(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        mine = held.value
        mine.prepare()
        for texts in batches:
            yield pd.Series([mine.mask(t) for t in texts], dtype=np.int64)

    vote.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    usable = F.coalesce(fold("doc_id", FOLDS) != HELD_OUT, F.lit(False))
    return docs.select(F.xxhash64(whole_text()).alias("text_hash"), F.pandas_udf(vote, "long")(whole_text()).alias("mask"), usable.alias("usable"), *also)


def posterior_sample(masks: DataFrame, label_model: LabelModel) -> DataFrame:
    """(text_hash, posterior, weight): at most POSTERIORS_A_SIDE texts on either side of one half, the first by hash, weighed back to the sides' shares."""

    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for found in batches:
            yield pd.Series(label_model.posterior(unpack(found.to_numpy(np.int64))), dtype=np.float64)

    judge.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    rows = masks.where("usable").groupBy("text_hash", "mask").agg(F.count(F.lit(1)).alias("copies")).withColumn("posterior", F.pandas_udf(judge, "double")("mask"))
    rows = stored(rows.select("text_hash", "copies", "posterior", (F.col("posterior") >= 0.5).alias("side")), "posteriors")
    sizes = {r.side: r.n for r in rows.groupBy("side").agg(F.sum("copies").alias("n")).collect()}
    picked = [rows.where(F.col("side") == side).orderBy(F.xxhash64("text_hash"), "text_hash").limit(POSTERIORS_A_SIDE) for side in (False, True)]
    sample = stored(picked[0].unionByName(picked[1]), "posterior-sample")
    taken = {r.side: r.n for r in sample.groupBy("side").agg(F.sum("copies").alias("n")).collect()}
    back = F.when(F.col("side"), sizes.get(True, 0) / max(1, taken.get(True, 0))).otherwise(sizes.get(False, 0) / max(1, taken.get(False, 0)))
    return sample.select("text_hash", "posterior", (F.col("copies") * back).alias("weight"))


def sample_votes(sample: DataFrame, voters: Voters) -> DataFrame:
    """(mask, label, n): the votes on the labelled sample (doc_id, label, text), in which each labelled row counts once, however many rows share its text."""
    return vote_masks(sample, voters, "label").groupBy("mask", "label").agg(F.count(F.lit(1)).alias("n"))


def labelled_by_votes(docs: DataFrame, labels: DataFrame, target: str = "toxic") -> tuple[pd.DataFrame, Voters, DataFrame, LabelModel]:
    """Names of features, the voters, the votes on each document and the label model of the votes on all of them."""
    sample_ids = labelled_sample(labels, target, FOLDS, HELD_OUT, SAMPLE_A_CLASS)
    sample = stored(texts_of(docs, sample_ids), "toxicity-sample")
    names = sample_names(sample)
    voters = Voters(stem_voters(names), clean_stem_voters(names))
    masks = stored(vote_masks(docs, voters), "toxicity-masks")
    votes = stored(masks.groupBy("mask").agg(F.count(F.lit(1)).alias("n")), "toxicity-votes")
    share = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull() & (fold("doc_id", FOLDS) != HELD_OUT)).agg(F.avg(F.col(target).cast("double"))).first()[0]
    prior = min(max(0.1 if share is None else float(share), 1e-3), 1 - 1e-3)
    start = starting_point(sample_votes(sample, voters), prior)
    return names, voters, masks, fit_label_model(votes, start)


def fit(docs: DataFrame, labels: DataFrame, target: str = "toxic") -> ToxicityModel:
    """Voters from the labelled sample, label model from the votes on all documents, classifier from posterior labels."""
    names, voters, masks, label_model = labelled_by_votes(docs, labels, target)
    return fit_classifier(docs, names, voters, posterior_sample(masks, label_model), label_model.prior)


def fit_classifier(docs: DataFrame, names: pd.DataFrame, voters: Voters, sample: DataFrame, prior: float) -> ToxicityModel:
    """A linear classifier on the sample's posterior labels (text_hash, posterior, weight); with nothing to learn from, the prior."""
    strongest = names.head(FEATURES)["name"].tolist()
    model = ToxicityModel(dict.fromkeys(dict.fromkeys([*[f"={w}" for w in LEXICON], *voters.stems, *strongest]), 0.0), math.log(prior / (1 - prior)))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def featurise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by = held.value
        by.prepare()
        for pdf in batches:
            yield pd.DataFrame({"text_hash": pdf["text_hash"], "posterior": pdf["posterior"], "weight": pdf["weight"], "present": [sorted(by.present(t)) for t in pdf["text"]]})

    # At most twice POSTERIORS_A_SIDE rows: broadcast to the texts, and their features collected. Copies of a text are one row with their weight.
    texts = docs.select(F.xxhash64(whole_text()).alias("text_hash"), whole_text().alias("text")).join(F.broadcast(sample), "text_hash")
    found = texts.mapInPandas(featurise, "text_hash long, posterior double, weight double, present array<int>")
    once = found.groupBy("text_hash").agg(F.first("posterior").alias("posterior"), F.first("weight").alias("weight"), F.first("present").alias("present"))
    rows = once.toPandas().sort_values("text_hash")
    if len(rows):
        present = [np.asarray(p, np.int64) for p in rows["present"]]
        w, b = fit_linear(present, rows["posterior"].to_numpy(np.float64), rows["weight"].to_numpy(np.float64), len(model.weights))
        model = ToxicityModel(dict(zip(model.weights, w.tolist(), strict=True)), b)
    return model


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Add ``toxicity`` (0 to 1) to each document, from its text alone.

    Null texts count as empty; equal texts get equal scores; texts of any length are read
    whole; an empty table stays empty. Other columns stay, one named ``toxicity`` is replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        mine = held.value
        mine.prepare()
        for texts in batches:
            yield pd.Series([mine.score(t) for t in texts], dtype=np.float64)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.withColumn("toxicity", F.pandas_udf(run, "double")(whole_text()))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each document; other columns are dropped.

    Null texts count as empty; a null doc_id has a null held_out; repeated rows get equal
    results; without labels the lexicon and the patterns alone vote. An empty table stays empty.
    """
    return score(docs, fit(docs, labels)).select(
        "doc_id",
        (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"),
    )
