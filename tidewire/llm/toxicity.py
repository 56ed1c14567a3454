"""Toxicity of texts behind obfuscated spelling: a noisy-channel decoder restores words, then words are weighed.

Channel: letters may be written as look-alike digits and signs, repeated, or set apart by spaces and signs.  A token
becomes a lattice of readings with costs; the Viterbi path under a character 4-gram model (interpolated over shorter
contexts, word border included) is its restored text.  Letters without a doubled one have one reading and are taken as
they stand.  Neighbouring tokens that together could be a word with strong evidence are read as one lattice too.

Character model: counts of the words of all texts in two rows of ``CELLS`` hashed cells; a gram's count is the smaller
of its two cells.  So the model covers the whole corpus, has one size for any corpus, and leaves no gram out.

Evidence: restored words and their beginnings, each with the share of toxic texts among the labelled texts that hold
it, drawn towards the base rate.  The three words of a text with the strongest evidence and its length go into a
logistic model, fitted on leave-one-out evidence of the labelled texts.  Evidence and weights are learned on at most
``sample`` labelled rows (those with the smallest hash), a documented bound; scoring covers every text, whole.

Only words with evidence matter, so a token is decoded only if a reading of it could be or begin with such a word: its
letters in classes of look-alikes, doubled ones as one, tell (``Finder.possible``).
"""

from __future__ import annotations

import heapq
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.blocks import text_runs
from tidewire.llm.char_grams import Grams, keys_of
from tidewire.llm.storage import stored

#: Letters that digits and signs stand for. (fixed values)
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i",
}
EDGE = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in LOOKALIKES) + ")!|«»„“”‘’…¿¡–—"
_PLAIN = "".join(c for c in EDGE if c not in LOOKALIKES)
ORDER, CELLS, LEAN = 4, 1 << 21, 4.0
RUN_BYTES = 4_000_000
STARTS = (3, 4, 5, 6, 7)
#: Evidence from which on words written in several tokens are looked for.
JOIN_AT = 0.5
#: Costs (negative log probabilities) of the channel's edits.
SWAP, KEEP, DROP, SPLIT, SHRINK, PAIR, TOGETHER, BORDER, APART = 1.5, 9.0, 1.0, 4.0, 1.0, 3.0, 0.5, 1.5, 5.0
_DOUBLE = re.compile(r"(.)\1")
_TRIPLE = re.compile(r"(.)\1\1")
_NOISE = re.compile(r"^([^\w\s])\1{2,}|([^\w\s])\2{2,}$")
_PARTS = re.compile(r"[^\w]|_")


def decomposed(token: str) -> str:
    return token if token.isascii() else unicodedata.normalize("NFKC", token)


class CharModel:
    """Character n-gram model from hashed counts of grams of 1 to ``ORDER`` characters and of their contexts."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.costs: dict[tuple[str, str], float] = {}

    def _count(self, key: int) -> float:
        a, b = _places(key)
        return float(min(self.table[0, a], self.table[1, b]))

    def count(self, gram: str) -> float:
        """How often the gram was seen; a space is the word border."""
        return self._count(keys_of(gram[:-1], gram[-1])[1])

    def cost(self, context: str, char: str) -> float:
        """Negative log probability of ``char`` after ``context``, each order leaning on the shorter one."""
        known = self.costs.get((context, char))
        if known is None:
            p = 1e-5
            for k in range(len(context), -1, -1):
                before, gram = keys_of(context[k:], char)
                n = self._count(before)
                if n:
                    p = (min(self._count(gram), n) + LEAN * p) / (n + LEAN)
            if len(self.costs) > 100_000:
                self.costs.clear()
            known = self.costs[context, char] = -math.log(p)
        return known


def _places(key):
    """The two cells of a key, from its high and its middle bits."""
    return key >> 43, (key >> 20) & (CELLS - 1)


def counted(words: dict[str, int], table: np.ndarray | None = None) -> np.ndarray:
    """Counts of the grams of words in two rows of cells, added to ``table`` if there is one."""
    table = np.zeros((2, CELLS), dtype=np.int64) if table is None else table
    kinds = list(words)
    for k in range(0, len(kinds), 10_000):
        part = kinds[k : k + 10_000]
        found = Grams.of(part, ORDER)
        times = np.fromiter(map(words.__getitem__, part), dtype=np.int64, count=len(part))[found.owner]
        for keys in (*found.grams, *found.contexts):
            first, second = keys >> np.uint64(43), (keys >> np.uint64(20)) & np.uint64(CELLS - 1)
            for row, at in enumerate((first, second)):
                np.add.at(table[row], at.astype(np.int64), times)
    return table


def readings(text: str, spaced: bool = False) -> Iterator[list[tuple[str, float]]]:
    """Lattice of a token: for each run of a character, what it may stand for and at which cost.

    ``spaced``: the text is a row of single characters with the spaces between them taken out.
    """
    i = 0
    while i < len(text):
        c, j = text[i], i
        while j < len(text) and text[j] == c:
            j += 1
        n, i = j - i, j
        if c.isalpha():
            yield [(c, SHRINK), (c * 2, SHRINK + 0.5)] if n > 2 else [(c, 0.0)] if n == 1 else [(c * 2, 0.0), (c, PAIR)]
        elif c in LOOKALIKES:
            out = [(x, SWAP) for x in LOOKALIKES[c]] + [(c * n, KEEP)]
            if n > 1:
                out += [(x * min(n, 3), SWAP * 1.5) for x in LOOKALIKES[c]]
            if not c.isdigit():
                out.append(("", DROP + 1))
            yield out
        elif c.isdigit():
            yield [(c * n, KEEP)]
        else:
            yield [("", DROP), (" ", SPLIT)]
        if spaced and i < len(text):
            yield [("", TOGETHER), (" ", BORDER)]


def decode(model: CharModel, lattice: Iterable[list[tuple[str, float]]]) -> str:
    """The cheapest path through a lattice under the model, from border to border.

    Every state, the last three characters, is kept.  A path is a chain of pieces, put together at the end.
    """
    ways: dict[str, tuple[float, tuple]] = {" " * (ORDER - 1): (0.0, ())}
    for options in lattice:
        found: dict[str, tuple[float, tuple]] = {}
        for state, (cost, path) in ways.items():
            for chars, price in options:
                total, now = cost + price, state
                for c in chars:
                    if c == " " and now[-1] == " ":
                        continue
                    total += model.cost(now, c)
                    now = now[1:] + c if c != " " else " " * (ORDER - 1)
                if now not in found or total < found[now][0]:
                    found[now] = (total, (path, chars))
        ways = found
    ends = [(cost + model.cost(s, " "), path) for s, (cost, path) in ways.items()]
    least = min(cost for cost, _ in ends)
    return min(_spelled(path) for cost, path in ends if cost == least)


def _spelled(path: tuple) -> str:
    out = []
    while path:
        path, chars = path
        out.append(chars)
    return "".join(reversed(out))


def restored(model: CharModel, token: str) -> list[str]:
    """Words that a token stands for, lower-cased: as written, in its parts, and as the decoder reads the whole."""
    t = decomposed(token).lower()
    if t.isalpha() and not _DOUBLE.search(t):
        return [t]
    core = _NOISE.sub("", t).strip(EDGE)
    signs = EDGE.replace("!", "").replace("|", "")
    rest = core if _NOISE.search(t) else t.strip(signs)
    out = [p for p in _PARTS.split(core) if p.isalpha() and not _TRIPLE.search(p) and (len(p) > 1 or p == core)]
    for text in {core: 0, rest: 0}:
        if text and not (text.isalpha() and not _DOUBLE.search(text)):
            out += decode(model, readings(text)).split()
    return list(dict.fromkeys(out))


def spaced_out(model: CharModel, tokens: list[str], singles: set[str] | None = None) -> list[str]:
    """Words that rows of at least three single characters stand for; ``singles``: the tokens of one character."""
    out, row = [], []
    for t in [*tokens, "  "]:
        if singles is not None and t not in singles and not row:
            continue
        bare = t.strip(".,;:*-_'\"")
        if len(bare) == 1 and (bare.isalpha() or bare in LOOKALIKES):
            row.append(bare.lower())
            continue
        if len(row) > 2:
            out += decode(model, readings("".join(row), spaced=True)).split()
        row = []
    return out


#: Letters and signs that one sign may stand for, as one letter; signs that only set apart go.
_ALIKE = {"l": "i", "b": "g"}
_SAME = str.maketrans(
    dict.fromkeys(EDGE) | {"l": "i", "b": "g"} | {c: _ALIKE.get(x[0], x[0]) for c, x in LOOKALIKES.items()}
)


class Joined:
    """Finds words with evidence that are written in several tokens (``st up id``); rows of plain numbers are numbers."""

    def __init__(self, words: Iterable[str]):
        self.keys: dict[str, set[str]] = {}
        for w in words:
            self.keys.setdefault(w.translate(_SAME), set()).add(w)
        self.starts = {k[:n] for k in self.keys for n in range(1, len(k) + 1)}
        self.inner = {k[i:] for k in self.starts for i in range(len(k))}

    @staticmethod
    def piece(token: str) -> str:
        """What a token gives to a joined word."""
        return decomposed(token).lower().translate(_SAME)

    def later(self, token: str, piece: str) -> tuple[str, str] | None:
        """What a token gives inside and at the end of a word, where signs may be letters or not; None: it is in no word."""
        shorn = self.piece(token.rstrip("!|")) if token[-1] in "!|" else piece
        return (piece, shorn) if not piece or piece in self.inner or shorn in self.inner else None

    def words(self, model: CharModel, tokens: list[str], first: dict[str, str] | None = None, later: dict[str, tuple[str, str]] | None = None) -> set[str]:
        """Words whose pieces stand side by side and which the decoder prefers to the pieces.

        ``first`` and ``later``: the tokens that a word may begin and go on with and what they give, if that is known.
        """
        if first is None or later is None:
            pieces = {t: self.piece(t) for t in set(tokens)}
            first = {t: p for t, p in pieces.items() if p in self.starts}
            later = {t: found for t, p in pieces.items() if (found := self.later(t, p))}
        out: set[str] = set()
        for i, token in enumerate(tokens):
            if token not in first:
                continue
            before = first[token]
            for j in range(i + 1, len(tokens)):
                if tokens[j] not in later:
                    break
                now, shorn = later[tokens[j]]
                if not now:
                    continue
                for last in (now, shorn) if now != shorn else (now,):
                    for word in self.keys.get(before + last, ()) if last else ():
                        parts = [*filter(None, map(self.piece, tokens[i:j])), last]
                        if word not in out and not all(t.isdigit() for t in tokens[i : j + 1]) and self._preferred(model, word, parts):
                            out.add(word)
                before += now
                if before not in self.starts:
                    break
        return out

    def _preferred(self, model: CharModel, word: str, pieces: list[str]) -> bool:
        """The pieces cut the word; each gap is a border, or a space inside the word at a cost."""
        cut, lattice = 0, []
        for p in pieces:
            if lattice:
                lattice.append([("", APART), (" ", 0.0)])
            lattice.append([(word[cut : cut + len(p)], 0.0)])
            cut += len(p)
        return decode(model, lattice) == word


def features(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in STARTS if len(word) > n)]


def split_words(text: str) -> list[str]:
    return text.split()


_RUNS = re.compile(r"(.)\1+")
_ODD = re.compile(r"[^\W_]+|[\W_]")


def outline(text: str) -> str:
    """Letters and signs by class of look-alikes, runs as one, signs that only set apart left out."""
    return _RUNS.sub(r"\1", text.translate(_SAME))


class Beginnings:
    """Set of beginnings of words; their lengths are kept by their first characters."""

    def __init__(self, texts: Iterable[str]):
        self.texts = set(texts)
        self.least = min(map(len, self.texts), default=0)
        self.sizes: dict[str, list[int]] = {}
        for head, n in sorted({(t[: self.least], len(t)) for t in self.texts}):
            self.sizes.setdefault(head, []).append(n)

    def of(self, text: str) -> bool:
        """Whether the text begins with one of them."""
        for n in self.sizes.get(text[: self.least], ()):
            if text[:n] in self.texts:
                return True
        return False


def single(token: str) -> bool:
    return len(token) == 1 or len(token.strip(".,;:*-_'\"")) == 1


class Finder:
    """Finds the restored words of texts that carry one of the given features; what recent tokens gave is kept."""

    def __init__(self, model: CharModel, wanted: Iterable[str], joined: Iterable[str] = (), most: int = 150_000):
        self.model, self.wanted, self.most = model, set(wanted), most
        self.heads = Beginnings(f[:-1] for f in self.wanted if f.endswith("*"))
        self.whole = {outline(f) for f in self.wanted if not f.endswith("*")}
        self.starts = Beginnings(map(outline, self.heads.texts))
        self.joined = Joined(joined)
        self.longest = max(map(len, self.joined.starts), default=0)
        self.known: set[str] = set()
        self.often: set[str] = set()
        self.words_of: dict[str, tuple[str, ...]] = {}
        self.singles: set[str] = set()
        self.first: dict[str, str] = {}
        self.later: dict[str, tuple[str, str]] = {}

    def carries(self, word: str) -> bool:
        return word in self.wanted or self.heads.of(word[:-1])

    def possible(self, token: str) -> bool:
        """Whether some reading of a lower-cased token could carry a feature: never false where one does.

        A word of a reading joins neighbouring parts; a look-alike sign is its letter, or it sets apart or goes.
        """
        parts, signs = [], 0
        for piece in _ODD.findall(token):
            if piece[0].isalnum():
                if not piece.isascii() and not all(c.isalpha() or c.isdigit() for c in piece):
                    return True
                parts.append(("letters", piece.translate(_SAME)))
            elif piece in LOOKALIKES:
                if parts and parts[-1] == ("sign", _SAME[ord(piece)]):
                    continue
                parts.append(("sign", _SAME[ord(piece)]))
                signs += 1
        if signs > 5 or len(parts) > 12:
            return True
        places = [i for i, (kind, _) in enumerate(parts) if kind == "sign"]
        for chosen in range(1 << len(places)):
            left_out = {i for k, i in enumerate(places) if not chosen >> k & 1}
            units = [text for i, (_, text) in enumerate(parts) if i not in left_out]
            for i in range(len(units)):
                so_far = ""
                for unit in units[i:]:
                    so_far += unit
                    if _RUNS.sub(r"\1", so_far) in self.whole:
                        return True
                line = _RUNS.sub(r"\1", so_far)
                if self.starts.of(line):
                    return True
        return False

    def token(self, token: str, lower: str | None = None, piece: str | None = None) -> tuple[str, ...]:
        """Words with a feature that a token of several characters stands for; its lower case and its classes may be given."""
        if lower is None or piece is None:
            lower, piece = decomposed(token).lower(), Joined.piece(token)
        bare = lower if lower.isalpha() else lower.strip(_PLAIN)
        if bare.isalpha():
            if not _DOUBLE.search(bare):
                return (bare,) if self.carries(bare) else ()
            # signs that only set apart give nothing to a piece
            line = _RUNS.sub(r"\1", piece)
            if line not in self.whole and not self.starts.of(line):
                return ()
        elif not self.possible(lower):
            return ()
        return tuple(filter(self.carries, restored(self.model, token)))

    def _learn(self, tokens: set[str]) -> None:
        """Keep what tokens stand for; they are lower-cased and brought into classes as one string."""
        self.known |= tokens
        for kinds in (list(filter(str.isascii, tokens)), list(filterfalse(str.isascii, tokens))):
            lower = decomposed("\n".join(kinds)).lower()
            for token, t, piece in zip(kinds, lower.split("\n"), lower.translate(_SAME).split("\n"), strict=False):
                if (len(token) == 1 or not token.isalpha()) and single(token):
                    self.singles.add(token)
                elif words := self.token(token, t, piece):
                    self.words_of[token] = words
                # a piece of letters is no longer than the word
                if self.joined.keys and (len(token) <= self.longest or not token.isalnum()):
                    if piece in self.joined.starts:
                        self.first[token] = piece
                    if found := self.joined.later(token, piece):
                        self.later[token] = found

    def _forget(self) -> None:
        """Of what is kept, only tokens of more than one text stay; nothing where they are many, too."""
        kept = self.often if len(self.often) <= self.most // 2 else set()
        self.known, self.often = kept, set()
        self.singles &= kept
        for held in (self.words_of, self.first, self.later):
            for token in held.keys() - kept:
                del held[token]

    def text(self, text: str) -> tuple[set[str], int]:
        """Distinct restored words with a feature, and the number of tokens; rows of single characters count as one."""
        tokens = split_words(text)
        kinds = set(tokens)
        if len(self.known) > self.most:
            self._forget()
        new = kinds.difference(self.known)
        self.often |= kinds - new
        self._learn(new)
        found = {w for t in self.words_of.keys() & kinds for w in self.words_of[t]}
        if not self.singles.isdisjoint(kinds) and sum(map(self.singles.__contains__, tokens)) > 2:
            found.update(filter(self.carries, spaced_out(self.model, tokens, self.singles)))
        if not kinds.isdisjoint(self.first):
            found.update(self.joined.words(self.model, tokens, self.first, self.later))
        return found, len(tokens)


def summary(strengths: Iterable[float], tokens: int, base: float) -> list[float]:
    """What the logistic model sees of a text: log odds of the three strongest words, its length, one."""
    top = [*heapq.nlargest(3, strengths), base, base, base][:3]
    return [*(math.log(q / (1 - q)) for q in top), math.log1p(tokens), 1.0]


class Weigher:
    """Evidence of texts."""

    def __init__(self, model: CharModel, evidence: dict[str, float], base: float):
        self.evidence, self.base = evidence, base
        strong = (f for f, q in evidence.items() if not f.endswith("*") and q >= JOIN_AT)
        self.finder = Finder(model, evidence, strong)

    def word(self, word: str) -> float:
        return max(self.evidence.get(f, 0.0) for f in features(word))

    def text(self, text: str) -> list[float]:
        words, tokens = self.finder.text(text)
        return summary(map(self.word, words), tokens, self.base)


@dataclass
class Model:
    chars: CharModel
    evidence: dict[str, float]
    base: float
    weights: np.ndarray


SUMMARY = 5


def fitted(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic model, by damped Newton steps with a weak ridge; without rows, the strongest word alone."""
    w = np.array([1.0, 0.0, 0.0, 0.0, 0.0])
    if not len(x):
        return w
    ridge = np.array([1e-2, 1e-2, 1e-2, 1e-2, 1e-4])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (y - p) - ridge * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hess, grad)
        w = w + step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
    return w


def char_model(texts: DataFrame) -> CharModel:
    """Character model of the words of all texts (one column), tokens of letters between signs."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        total = np.zeros((2, CELLS), dtype=np.int64)

        def add() -> None:
            words: Counter = Counter()
            for token, n in seen.items():
                if (word := token.strip(EDGE)).isalpha():
                    words[word] += n
            seen.clear()
            counted(words, total)

        for batch in batches:
            for _, run in text_runs(batch.column(0), RUN_BYTES):
                for t in run:
                    seen.update(t.lower().split())
                if len(seen) > 150_000:
                    add()
        add()
        for row in range(2):
            at = np.flatnonzero(total[row])
            yield pa.record_batch([pa.array(at + row * CELLS), pa.array(total[row][at])], ["cell", "n"])

    found = texts.mapInArrow(cells, "cell long, n long").groupBy("cell").agg(F.sum("n").cast("float").alias("n"))
    rows = stored(found, "toxic-cells").toArrow()  # at most 2 * CELLS rows of 12 bytes
    table = np.zeros(2 * CELLS, dtype=np.float32)
    table[rows.column("cell").to_numpy()] = rows.column("n").to_numpy()
    return CharModel(table.reshape(2, CELLS))


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = 20_000, prior: float = 10.0, lift: float = 3.0) -> Model:
    """Learn from the labelled rows given (the caller keeps held-out rows away), at most ``sample`` of them.

    Rows with a null label, id or text teach nothing; an id that several rows hold teaches with each.  Without labels or
    documents every text gets the same score.  Only the named columns are read.  A feature is evidence if the share of
    toxic texts among those that hold it is more than ``lift`` times that of all.
    """
    usable = labels.filter(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).select(F.col(doc_id).alias("doc_id"), (F.col(label) == 1).cast("int").alias("y"))
    usable = usable.groupBy("doc_id").agg(F.max("y").alias("y"))
    # at most `sample` rows of an id and a digit, so they fit into every task
    chosen = F.broadcast(usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    texts = stored(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter("text is not null").join(chosen, "doc_id").select("text", "y"), "toxic-sample")

    chars = char_model(docs.select(F.col(text).alias("text")))
    totals = texts.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count(F.lit(1))).first()
    base = (totals[0] + 0.1) / (totals[1] + 1)

    def beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Features of toxic texts with the number of texts."""
        held: Counter = Counter()
        known: dict[str, list[str]] = {}
        for batch in batches:
            for t in batch.column(0).to_pylist():
                held.update({f for w in all_words(chars, t, known) for f in features(w)})
        yield pa.record_batch([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["f", "bad"])

    bad = texts.filter("y = 1").select("text").mapInArrow(beginnings, "f string, bad long").groupBy("f").agg(F.sum("bad").alias("bad"))
    wanted = {r["f"]: r["bad"] for r in bad.filter("bad > 2").collect()}

    def at_least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Features with the number of texts that hold them in words of plain letters, which are restored as written."""
        held: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                plain = (w for w in set(t.lower().split()) if len(w) > 1 and w.isalpha() and not _DOUBLE.search(w))
                held.update({f for w in plain for f in features(w) if f in wanted})
        yield pa.record_batch([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["f", "n"])

    # a feature that these texts alone make too common can be no evidence and need not be looked for
    plain = texts.select("text").mapInArrow(at_least, "f string, n long").groupBy("f").agg(F.sum("n").alias("n"))
    for r in plain.collect():
        if (wanted[r["f"]] + prior * base) / (max(r["n"], wanted[r["f"]]) + prior) <= lift * base:
            del wanted[r["f"]]

    def seen_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of every labelled text the words with a wanted feature."""
        finder = Finder(chars, wanted)
        for batch in batches:
            found = [finder.text(t) for t in batch.column(0).to_pylist()]
            words = pa.array([sorted(w) for w, _ in found], pa.list_(pa.string()))
            yield pa.record_batch([words, pa.array([n for _, n in found], pa.int32()), batch.column(1)], ["words", "tokens", "y"])

    held = stored(texts.mapInArrow(seen_in, "words array<string>, tokens int, y int"), "toxic-words")

    def counted_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for batch in batches:
            for words in batch.column(0).to_pylist():
                n.update({f for w in words for f in features(w) if f in wanted})
        yield pa.record_batch([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64())], ["f", "n"])

    n_of = {r["f"]: r["n"] for r in held.select("words").mapInArrow(counted_in, "f string, n long").groupBy("f").agg(F.sum("n").alias("n")).collect()}
    evidence = {f: (b + prior * base) / (n_of[f] + prior) for f, b in wanted.items() if f in n_of}
    evidence = {f: q for f, q in evidence.items() if q > lift * base}
    counts = {f: (wanted[f], n_of[f]) for f in evidence}

    def leave_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for words, tokens, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                known = ([counts[f] for f in features(w) if f in counts] for w in words)
                strengths = (max((b - y + prior * base) / (n - 1 + prior) for b, n in each) for each in known if each)
                rows.append([*summary(strengths, tokens, base), float(y)])
            yield pa.record_batch([pa.array([r[k] for r in rows], pa.float64()) for k in range(SUMMARY + 1)], names)

    names = [*(f"x{k}" for k in range(SUMMARY)), "y"]
    points = held.mapInArrow(leave_out, ", ".join(f"{n} double" for n in names)).toPandas().to_numpy()
    return Model(chars, evidence, base, fitted(points[:, :SUMMARY], points[:, SUMMARY]))


def all_words(model: CharModel, text: str, known: dict[str, list[str]]) -> set[str]:
    """Distinct restored words of a text, with or without evidence; single characters count in rows only.  ``known`` keeps what tokens stand for."""
    tokens = split_words(text)
    if len(known) > 200_000:
        known.clear()
    for t in set(tokens):
        if t not in known:
            known[t] = [] if single(t) else restored(model, t)
    return {w for t in set(tokens) for w in known[t]}.union(spaced_out(model, tokens))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``score`` double, 0 to 1 (a column of that name is replaced).

    Null, empty and blank texts score as texts without evidence.  Every row is scored on its own, repeats alike; an
    empty table stays empty.  Only the texts go through the workers.
    """

    def rate(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weigher = Weigher(model.chars, model.evidence, model.base)
        for texts in batches:
            seen = [weigher.text(t) for _, run in text_runs(texts, RUN_BYTES) for t in run]
            x = np.array(seen, dtype=float).reshape(-1, SUMMARY)
            yield pa.array(1 / (1 + np.exp(-np.clip(x @ model.weights, -30, 30))))

    # typed here, as annotations are only names in this module
    rate.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.drop("score").withColumn("score", F.arrow_udf(rate, "double")(F.col(f"`{text}`").cast("string")))
