"""Toxicity scores of deobfuscated text: a noisy channel over character lattices.

Insults are written as ``1d10t``, ``i d i o t``, ``id iot`` or ``iiidiooot``. The channel reads each
written character as one of the letters that it imitates, as another copy of the letter
before, or as a mark between letters. A Viterbi search over the text's lattice weighs every
reading of a piece of text as a lexicon word (channel costs plus the word under a character
trigram model) against the piece as it stands (its words under the same model); the likeliest
choice of pieces that don't overlap is the restored text. A Bernoulli model over the lexicon,
calibrated on the labelled rows, gives the score.

The search is exact and linear in the text. Characters that can be read as the same letter form
classes, so a piece that can be read as a word has the word's classes in order; these are found
all at once by one automaton over the text's classes, over blanks and line breaks too. As the
cost of what stands as written adds up over words, the best path is the best choice of found pieces.

The lexicon is learnt from labelled rows: words seen in toxic documents far more
often than in others, and next to many different words, so that a toxic document
which occurs in many copies doesn't make all its words toxic. Nothing in it depends on the language. All labelled
rows outside the evaluation fold are counted, as whole texts, by tasks.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stash, join_checked

#: Characters that imitate letters.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "{": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "¢": "c",
}
#: Letters of other scripts that look like Latin ones, and the Latin ones in the same order.
HOMOGLYPHS = dict(zip("аеорсухіјѕԁһкмтвнοαερικυν", "aeopcyxijsdhkmtbhoaepikuv"))
#: Letters that are written for each other.
SWAPPED = {"l": "i", "i": "l"}

#: Costs of the channel: an imitated letter, a swapped one, a further copy of a letter, and leaving out what stands between letters
#: where both neighbours are single characters, one is, or neither.
IMITATED, SWAP, COPY, BETWEEN = 0.1, 2.0, 0.3, (0.2, 2.0, 4.0)
#: What a reading of several pieces or of other characters must be likelier by than the text as it stands.
MARGIN = 1.0
#: Highest score of a text in which no lexicon word is found.
NO_EVIDENCE = 0.1

_WORD = re.compile(r"[^\W\d_]+")
_RUN = re.compile(r"\w+|[^\w\s]+")


@dataclass
class CharModel:
    """Character trigrams with backoff, over words framed by ``^`` and ``$``."""

    tri: dict = field(default_factory=dict)
    bi: dict = field(default_factory=dict)
    uni: dict = field(default_factory=dict)
    total: float = 1.0

    @classmethod
    def fit(cls, words: dict[str, float]) -> CharModel:
        tri, bi, uni = Counter(), Counter(), Counter()
        for w, c in words.items():
            s = f"^{w}$"
            for i, ch in enumerate(s):
                uni[ch] += c
                if i:
                    bi[s[i - 1 : i + 1]] += c
                if i > 1:
                    tri[s[i - 2 : i + 1]] += c
        return cls(dict(tri), dict(bi), dict(uni), float(sum(uni.values())) or 1.0)

    def cost(self, before: str, ch: str) -> float:
        """-log P(ch | up to two characters before)."""
        one, two = before[-1:], before[-2:]
        p = 0.02 * (self.uni.get(ch, 0) + 0.5) / (self.total + 50)
        p += 0.18 * self.bi.get(one + ch, 0) / (self.uni.get(one, 0) + 1.0)
        if len(two) == 2:
            p += 0.8 * self.tri.get(two + ch, 0) / (self.bi.get(two, 0) + 0.1)
        else:
            p *= 5
        return -math.log(min(1.0, p))


def _classes() -> dict[str, int]:
    """Class numbers from 1 of the characters that can be read as letters: those with a common reading share one."""
    group = {c: c for c in "abcdefghijklmnopqrstuvwxyz"}

    def root(c):
        while group[c] != c:
            c = group[c]
        return c

    for written, letters in [*LEET.items(), *HOMOGLYPHS.items(), *SWAPPED.items()]:
        group.setdefault(written, letters[0])
        for x in (written, *letters):
            group[root(x)] = root(letters[0])
    return {c: ord(root(c)) - ord("a") + 1 for c in group}


CLASSES = _classes()


@lru_cache(4)
def _table(symbols: bool) -> np.ndarray:
    """Class of every character; letters without imitations are classes of their own (from 64 on), other characters are 0.

    ``symbols``: whether marks that imitate letters are read as these; if not, they stand between letters.
    """
    table = np.zeros(0x110000, np.uint32)
    for at in range(128, 0x110000):  # by blocks of letters, once a process
        if chr(at).isalpha():
            table[at] = at + 64
    for c, k in CLASSES.items():
        table[ord(c)] = k if symbols or c.isalnum() else 0
    return table


def skeleton(text: str, symbols: bool):
    """(classes of the text's letters without repetitions, as a string; places of all letters; where each run begins among them)."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    classes = _table(symbols)[codes]
    at = np.flatnonzero(classes)
    own = classes[at]
    begin = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else own
    return own[begin].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass"), at, begin


def align(span: str, word: str, symbols: bool) -> float:
    """Least channel cost of reading ``span`` as ``word``; infinite where it can't be. Within a piece marks that imitate letters
    are either all letters (``symbols``) or all separators."""
    inf = math.inf
    cost = [inf] * (len(word) + 1)
    cost[0] = 0.0
    single = all(len(p) <= 1 for p in re.split(r"[\W_]+", span) if p)
    for i, ch in enumerate(span):
        nxt = [inf] * (len(word) + 1)
        reads = {ch: 0.0} if ch.isalpha() else {}
        for x in LEET.get(ch, "") if symbols or ch.isalnum() else "":
            reads.setdefault(x, IMITATED)
        if ch in HOMOGLYPHS:
            reads.setdefault(HOMOGLYPHS[ch], IMITATED)
        if ch in SWAPPED:
            reads.setdefault(SWAPPED[ch], SWAP)
        between = None
        if not ch.isalnum() and not (symbols and ch in LEET):
            # the first of some marks in a row carries their cost, by the length of the pieces at both sides
            first = i == 0 or span[i - 1].isalnum()
            between = (BETWEEN[0] if single else _between(span, i)) if first else 0.0
        for j in range(len(word) + 1):
            if cost[j] == inf:
                continue
            if j < len(word) and word[j] in reads:
                nxt[j + 1] = min(nxt[j + 1], cost[j] + reads[word[j]])
            if j and word[j - 1] in reads:
                nxt[j] = min(nxt[j], cost[j] + reads[word[j - 1]] + COPY)
            if j and between is not None:
                nxt[j] = min(nxt[j], cost[j] + between)
        cost = nxt
    return cost[-1]


def _between(span: str, i: int) -> float:
    """Cost of leaving out the marks from place i on: cheap between single characters, dear between longer pieces at a blank."""
    j = i
    while j < len(span) and not span[j].isalnum():
        j += 1
    left = 1 if i < 2 or not span[i - 2].isalnum() else 2
    right = 1 if j + 1 >= len(span) or not span[j + 1].isalnum() else 2
    if not any(c.isspace() for c in span[i:j]):
        return BETWEEN[0] if left == right == 1 else 1.0
    return BETWEEN[left + right - 2]


@dataclass
class ToxicModel:
    """A lexicon with log-odds, the channel's character model, and the score's calibration."""

    weight: dict[str, float]
    bias: float
    chars: CharModel
    scale: float = 1.0

    def __post_init__(self):
        import ahocorasick

        self.words: dict[str, list[str]] = {}
        for w in sorted(self.weight):
            self.words.setdefault(skeleton(w, False)[0], []).append(w)
        self.automaton = ahocorasick.Automaton()
        for k, ws in self.words.items():
            if k:
                self.automaton.add_word(k, (len(k), ws))
        if len(self.automaton):
            self.automaton.make_automaton()
        self.memo: dict = {}

    def __getstate__(self):
        return {k: getattr(self, k) for k in ("weight", "bias", "chars", "scale")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def written(self, span: str) -> float:
        """Cost of a piece as it stands: its words, and its marks where they aren't blanks."""
        total = 0.0
        for m in _RUN.finditer(span):
            part = m[0]
            if not part[0].isalnum() and part[0] != "_":
                continue
            before = "^"
            for ch in (*part, "$"):
                total += self.chars.cost(before, ch)
                before = (before + ch)[-2:]
        return total

    def gain(self, span: str, word: str, symbols: bool) -> float:
        """How much likelier the word is than the piece as it stands."""
        key = (span, word, symbols)
        if key not in self.memo:
            if len(self.memo) > 200_000:
                self.memo.clear()
            cost = align(span, word, symbols)
            self.memo[key] = -math.inf if cost == math.inf else self.written(span) - self.written(word) - cost - MARGIN
        return self.memo[key]

    def pieces(self, text: str) -> list[tuple[int, int, float, str]]:
        """(start, end, gain, word) of every piece of a lower-cased text that is likelier a lexicon word than what it stands for."""
        out = set()
        if not len(self.automaton):
            return []
        for symbols in (False, True):
            if symbols and not any(c in text for c in LEET if not c.isalnum()):
                continue
            classes, at, begin = skeleton(text, symbols)
            for end, (size, words) in self.automaton.iter(classes):
                first, last = end - size + 1, end
                # a run of one letter may belong to two words, so the piece begins and ends at the run's first or last place
                head = at[begin[first] : begin[first + 1] if first + 1 < len(begin) else len(at)]
                tail = at[begin[last] : begin[last + 1] if last + 1 < len(begin) else len(at)]
                heads = [int(p) for p in head if p == 0 or not text[p - 1].isalnum() or (symbols and not text[p].isalnum())]
                tails = [int(p) for p in tail if p + 1 == len(text) or not text[p + 1].isalnum() or (symbols and not text[p].isalnum())]
                if heads and tails:
                    for p, q in {(p, q) for p in (heads[0], heads[-1]) for q in (tails[0], tails[-1]) if p <= q}:
                        span = text[p : q + 1]
                        for w in words:
                            if span == w:
                                out.add((p, q + 1, math.inf, w))
                            elif (g := self.gain(span, w, symbols)) > 0:
                                out.add((p, q + 1, g, w))
        return sorted(out, key=lambda x: (x[1], x[0], x[3]))

    def restored(self, text: str | None) -> list[str]:
        """Lexicon words of the likeliest restored text, in order."""
        if not text:
            return []
        found = self.pieces(text.lower())
        best: list[tuple[float, int, int]] = [(0.0, -1, -1)]  # gain, piece taken, choice before
        ends = [p[1] for p in found]
        for i, (start, _, gain, _) in enumerate(found):
            before = bisect_right(ends, start, 0, i)
            take = best[before][0] + min(gain, 1e6)
            best.append((take, i, before) if take > best[i][0] else (best[i][0], -1, i))
        out, at = [], len(found)
        while at > 0:
            _, piece, before = best[at]
            if piece >= 0:
                out.append(found[piece][3])
            at = before
        return out[::-1]

    def found(self, text: str | None) -> set[str]:
        return set(self.restored(text))

    def score_of(self, words: set[str]) -> float:
        z = self.bias + self.scale * sum(self.weight[w] for w in words)
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))

    def score(self, text: str | None) -> float:
        return self.score_of(self.found(text))


def calibrate(stats, bias: float, rounds: int = 50) -> tuple[float, float]:
    """(bias, scale) of a logistic regression of the label on the summed weights: words of a family (of one stem, say) come
    together, so single ones prove less than the sum of many would say. Drawn towards the given bias and a scale of 1.

    ``stats(bias, scale)`` gives five sums over all rows, with z a row's summed weights, y its label and p its probability
    of 1: p - y, (p - y) z, p (1 - p), p (1 - p) z and p (1 - p) z^2. The result is rounded, as sums depend on the order of rows.
    """
    w, prior, firm = np.asarray([bias, 1.0]), np.asarray([bias, 1.0]), np.asarray([0.05, 2.0])
    for _ in range(rounds):
        g0, g1, h0, h1, h2 = stats(float(w[0]), float(w[1]))
        grad = np.asarray([g0, g1]) + firm * (w - prior)
        hess = np.asarray([[h0, h1], [h1, h2]]) + np.diag(firm)
        step = np.linalg.solve(hess, grad)
        most = float(np.abs(step).max())
        w = w - step * min(1.0, 2.0 / max(1e-9, most))
        if most < 1e-11:
            break
    return round(float(w[0]), 9), round(float(max(w[1], 0.05)), 9)


def first_neighbours(text: str | None) -> dict[str, str]:
    """A text's different words, each with the word before its first occurrence (``^`` where there is none)."""
    out, before = {}, "^"
    for m in _WORD.finditer((text or "").lower()):
        w = m[0]
        if w not in out:
            out[w] = before
        before = w
    return out


def worth(text: str | None, weight: dict[str, float]) -> float:
    """Summed weights of the lexicon words that a text holds as they are written."""
    return math.fsum(weight[w] for w in first_neighbours(text).keys() & weight.keys())


def assemble(strong, common, clean: int, toxic: int, over) -> ToxicModel:
    """The model of lexicon words ``(word, clean, toxic documents)``, the commonest words ``(word, documents)`` and the numbers of
    documents. ``over(weight)`` gives the sums for ``calibrate`` over all rows."""
    weight, bias = {}, math.log((toxic + 1) / (clean + 1))
    for w, c0, c1 in strong:
        p, q = (c1 + 0.5) / (toxic + 1), (c0 + 0.5) / (clean + 1)
        bias += math.log((1 - p) / (1 - q))
        weight[w] = math.log(p / q) - math.log((1 - p) / (1 - q))
    lm = {w: math.sqrt(n) for w, n in common}
    boost = 1.0 + 0.02 * sum(lm.values())
    lm.update({w: boost for w in weight})
    top = math.log(NO_EVIDENCE / (1 - NO_EVIDENCE))
    bias, scale = max(min(bias, top), -5.0), 1.0
    if weight:
        bias, scale = calibrate(over(weight), bias)
        bias = min(bias, top)
    return ToxicModel(weight, bias, CharModel.fit(lm), scale)


def fit(rows, least: int = 4, share: float = 0.7, contexts: int = 20, max_lexicon: int = 2_000, lm_words: int = 20_000) -> ToxicModel:
    """Learn from an iterable of (text, label 0 or 1), in memory; ``train`` learns the same from tables of any size.

    A lexicon word occurs in at least ``least`` toxic documents, first after at least
    ``least`` (and half as many, or ``contexts``) different words, and ``share`` of its
    documents are toxic. A text without lexicon words scores ``NO_EVIDENCE`` at most, however
    the labels are shared out; without labelled rows the lexicon is empty.
    """
    rows = list(rows)
    count, near = [Counter(), Counter()], {}
    for text, y in rows:
        # one neighbour a document (the first), which its copies share
        words = first_neighbours(text)
        count[y].update(words.keys())
        if y:
            for w, before in words.items():
                near.setdefault(w, set()).add(before)
    strong = [w for w, c in count[1].items() if len(w) > 1 and c >= least and c >= share * (c + count[0][w]) and len(near[w]) >= max(least, min(contexts, 0.5 * c))]
    strong = sorted(strong, key=lambda w: (-min(count[1][w], len(near[w])), w))[:max_lexicon]
    both = count[0] + count[1]
    common = sorted(both.items(), key=lambda x: (-x[1], x[0]))[:lm_words]

    def over(weight):
        z, y = np.asarray([worth(t, weight) for t, _ in rows]), np.asarray([float(y) for _, y in rows])

        def stats(bias, scale):
            p = 1 / (1 + np.exp(-np.clip(bias + scale * z, -30, 30)))
            g, h = p - y, p * (1 - p)
            return g.sum(), (g * z).sum(), h.sum(), (h * z).sum(), (h * z * z).sum()

        return stats

    toxic = sum(y for _, y in rows)
    return assemble([(w, count[0][w], count[1][w]) for w in strong], common, len(rows) - toxic, toxic, over)


def _batched(batches, entries, arrays, names: list[str], rows: int = 200_000, chars: int = 1 << 26):
    """Arrow batches (label, text) as counts: ``entries(text, y)`` gives a row's keys; what a task counts leaves it as soon as it
    holds that many keys, or those of that many characters."""
    import pyarrow as pa

    held, size = Counter(), 0
    for b in batches:
        for y, text in zip(b.column(0).to_pylist(), b.column(1)):
            text = text.as_py() or ""
            held.update(entries(text, y))
            size += len(text)
            if len(held) > rows or size > chars:
                yield pa.RecordBatch.from_arrays(arrays(held), names=names)
                held, size = Counter(), 0
    if held:
        yield pa.RecordBatch.from_arrays(arrays(held), names=names)


def _count_words(batches):
    """(word, before, y, n): documents by word and label, those of toxic ones also by the word before its first occurrence.
    The empty word counts the documents."""
    import pyarrow as pa

    def entries(text, y):
        words = first_neighbours(text)
        return [("", None, y), *((w, before if y else None, y) for w, before in words.items())]

    def arrays(held):
        return [pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.string()), pa.array([k[2] for k in held], pa.int32()), pa.array(held.values(), pa.int64())]

    yield from _batched(batches, entries, arrays, ["word", "before", "y", "n"])


def _count_worths(weight: dict[str, float]):
    """(z, y, n): documents by the summed weights of their lexicon words and by label."""

    def run(batches):
        import pyarrow as pa

        def arrays(held):
            return [pa.array([k[0] for k in held], pa.float64()), pa.array([k[1] for k in held], pa.int32()), pa.array(held.values(), pa.int64())]

        yield from _batched(batches, lambda text, y: [(worth(text, weight), y)], arrays, ["z", "y", "n"])

    return run


def labelled(docs: DataFrame, labels: DataFrame, out_of_fold: Column, stash: Stash, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """``(y, text)`` of every labelled row outside the fold. A label of an id that occurs twice counts once, toxic first; of
    rows that share an id each different text counts once."""
    y = labels.where(F.col(label_col).isin(0, 1) & ~out_of_fold).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("y"))
    y = stash.put("labels", y)
    rows = join_checked(docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("text")), y, "__id")
    again = stash.put("again", rows.groupBy("__id").count().where("count > 1").select("__id"))
    if not again.isEmpty():
        once = join_checked(rows, again, "__id", "left_anti")
        rows = once.unionByName(join_checked(rows, again, "__id", "left_semi").distinct())
    # written once, as they are read twice: where labels are too many to broadcast, texts are shuffled for them
    return stash.put("rows", rows.select("y", "text"))


def train(
    docs: DataFrame, labels: DataFrame, out_of_fold: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    least: int = 4, share: float = 0.7, contexts: int = 20, max_lexicon: int = 2_000, lm_words: int = 20_000,
) -> ToxicModel:
    """``fit`` over every labelled row outside the fold (see ``labelled``), whole texts, counted where they are. The driver
    takes the lexicon and the commonest words only, of at most ``max_lexicon`` and ``lm_words`` words."""
    stash = Stash(docs.sparkSession, "toxicity")
    rows = labelled(docs, labels, out_of_fold, stash, id_col, text_col, label_col)
    pairs = rows.mapInArrow(_count_words, "word string, before string, y int, n long").groupBy("word", "before")
    pairs = pairs.agg(F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("clean"), F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("toxic"))
    words = pairs.groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"), F.count("before").alias("near"))
    words = stash.put("words", words)
    whole = words.where("word = ''").first()
    words = words.where("word <> ''")
    c, near = F.col("toxic"), F.col("near")
    strong = words.where((F.length("word") > 1) & (c >= least) & (c >= F.lit(share) * (c + F.col("clean"))))
    strong = strong.where(near >= F.greatest(F.lit(float(least)), F.least(F.lit(float(contexts)), 0.5 * c)))
    strong = strong.orderBy(F.least(c, near).desc(), "word").limit(max_lexicon).select("word", "clean", "toxic").collect()
    both = F.col("clean") + c
    common = words.select("word", both.alias("n")).orderBy(F.desc("n"), "word").limit(lm_words).collect()

    def over(weight):
        sums = rows.mapInArrow(_count_worths(weight), "z double, y int, n long").groupBy("z", "y").agg(F.sum("n").alias("n"))
        sums = stash.put("sums", sums)

        def stats(bias, scale):
            z = F.col("z")
            p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.lit(bias) + F.lit(scale) * z))))
            of = sums.select("z", (F.col("n") * (p - F.col("y"))).alias("g"), (F.col("n") * p * (1 - p)).alias("h"))
            return of.agg(F.sum("g"), F.sum(F.col("g") * z), F.sum("h"), F.sum(F.col("h") * z), F.sum(F.col("h") * z * z)).first()

        return stats

    model = assemble(strong, common, whole["clean"] if whole else 0, whole["toxic"] if whole else 0, over)
    stash.remove()
    return model


def score_documents(docs: DataFrame, model: ToxicModel, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``(id, score, predicted, words)`` per row, or the columns of ``keep`` with score and predicted.

    Whole texts are read; a null or empty text gets the score of a text without
    lexicon words. Rows come back as often as they came; an empty table gives none. Columns of
    ``keep`` named score, predicted or words are replaced by the results.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: max_lexicon and the character model
    columns = [c for c in keep or [id_col] if c not in ("score", "predicted", "words")]

    def run(batches):
        import pyarrow as pa

        m = shared.value
        for b in batches:
            words = [m.found(t.as_py()) for t in b.column(0)]
            score = [m.score_of(found) for found in words]
            extra = [pa.array(score, pa.float64()), pa.array([int(s >= threshold) for s in score], pa.int32()), pa.array([sorted(x) for x in words], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(1, b.num_columns)), *extra], names=[*columns, "score", "predicted", "words"])

    out = docs.select(F.col(text_col).cast("string").alias("__text"), *columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields[1:])
    return out.mapInArrow(run, f"{schema}, score double, predicted int, words array<string>")
