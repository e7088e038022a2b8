"""BPE encoding and decoding through a minimal acyclic transducer of frequent words.

The frequent words of the corpus, as white space divides them and counted over all of it, are compiled into an
automaton whose states share suffixes. Its arcs carry numbers that add up, along the path of a word, to the word's place in a table of ids.
The automaton is one file of plain arrays, sent to the executors by Spark and memory-mapped there; a batch of
words walks through it at once. Words that it lacks are merged exactly, a batch at a time.

Results equal those of the tokenizers library for vocabulary files with NFC, white-space and lower-case
normalisation, a removing split and an end-of-word suffix.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, shared_path, stage, texts_of

#: Words compiled into the automaton; the rest are merged. Bounds the file (about 8 MB) and the driver's work.
LEXICON_SIZE = 131_072
#: Words with more symbols than this are merged one by one.
LONG = 48
#: Pieces that a task remembers before it forgets all but those of the slice at hand.
REMEMBERED = 120_000
SLOTS, MULTIPLIER, NONE = 18, 0x9E3779B97F4A7C15, 1 << 40
_WIDE = re.compile("[\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")  # white space beyond ASCII


#: Letters, numbers and lower-case forms that Unicode has gained since the version of ``unicodedata``, as
#: far as the tokenizers library knows them. Code points that neither knows are neither letters nor numbers.
NEW_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E),
    (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NEW_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
NEW_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B} | {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}


class Stands(dict):
    """Each code point as itself, but one that ``unicodedata`` doesn't know as a letter, number or sign that it does."""

    def __missing__(self, c: int) -> int:
        known = unicodedata.category(chr(c)) != "Cn"
        self[c] = c if known else 0xAA if any(a <= c <= b for a, b in NEW_LETTERS) else 0xB2 if any(a <= c <= b for a, b in NEW_NUMBERS) else 0xA7
        return self[c]


STANDS = Stands()


class Vocabulary:
    """What a vocabulary file says: merges by rank, special tokens, and the split of white-space free pieces."""

    def __init__(self, text: str):
        said = json.loads(text)
        model = said["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.ids = model["vocab"]
        self.tokens = {i: t for t, i in self.ids.items()} | {x["id"]: x["content"] for x in said["added_tokens"]}
        self.special = {x["content"]: x["id"] for x in said["added_tokens"]}
        self.number = [str(i) for i in range(max(self.tokens) + 1)]
        self.shown = {str(i): t for i, t in self.tokens.items()}
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        split = next(x for x in said["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.split = regex.compile(split["pattern"]["Regex"])
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.width = max(self.ids.values()) + 1
        self.merge = {self.ids[a] * self.width + self.ids[b]: (r, self.ids[a + b]) for r, (a, b) in enumerate(pairs)}
        # the same as arrays, hashed with linear probing: key, and rank and result in one number
        self.keys, self.codes = np.full(1 << SLOTS, -1, np.int64), np.full(1 << SLOTS, NONE, np.int64)
        for key, (rank, made) in self.merge.items():
            at = (key * MULTIPLIER % 2**64) >> (64 - SLOTS)
            while self.keys[at] >= 0:
                at = (at + 1) % (1 << SLOTS)
            self.keys[at], self.codes[at] = key, rank << 20 | made
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
        self.inner = np.array([self.ids[letters[b]] for b in range(256)], np.int64)
        self.last = np.array([self.ids[letters[b] + self.suffix] for b in range(256)], np.int64)

    def words(self, piece: str) -> list[str | int]:
        """The words of a piece without white space, normalised; special tokens as ids."""
        if "<" in piece and self.at_special and self.at_special.search(piece):
            out: list[str | int] = []
            for x in self.at_special.split(piece):
                out += [self.special[x]] if x in self.special else self.words(x) if x else []
            return out
        if piece.isascii():
            if piece.isalpha():
                return [piece.lower()]
            return self.split.findall(piece.lower())
        piece = unicodedata.normalize("NFC", piece)
        piece = "".join(c.lower() for c in piece) if "Σ" in piece else piece.lower()
        shape = piece.translate(STANDS)
        if shape == piece:
            return self.split.findall(piece)
        piece = piece.translate(NEW_LOWER)
        return [piece[m.start() : m.end()] for m in self.split.finditer(piece.translate(STANDS))]

    def pieces(self, pieces: list[str]) -> list[list[int]]:
        """The ids of pieces without white space; each distinct word is merged once."""
        split = list(map(self.words, pieces))
        words = list({w for ws in split for w in ws if w.__class__ is str})
        known: dict = dict(zip(words, self.many(words))) | {i: [i] for i in self.special.values()}
        return [known[ws[0]] if len(ws) == 1 else [i for w in ws for i in known[w]] for ws in split]

    def one(self, word: str) -> list[int]:
        """The ids of one word, by a heap of its pairs: rank first, then place."""
        raw = word.encode()
        at = [int(self.inner[b]) for b in raw[:-1]] + [int(self.last[raw[-1]])]
        n = len(at)
        before, after, heap = list(range(-1, n - 1)), list(range(1, n + 1)), []

        def push(i: int) -> None:
            j = after[i]
            if j < n and (m := self.merge.get(at[i] * self.width + at[j])):
                heapq.heappush(heap, (m[0], i, at[i], at[j], m[1]))

        for i in range(n - 1):
            push(i)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            if at[i] != a or (j := after[i]) >= n or at[j] != b:
                continue
            at[i], at[j], after[i] = new, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                push(i)
            if before[i] >= 0:
                push(before[i])
        return [x for x in at if x >= 0]

    def codes_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank and result of each pair, NONE where nothing joins (or a place is empty, -1)."""
        key = a * self.width + b
        at = ((key.view(np.uint64) * np.uint64(MULTIPLIER)) >> np.uint64(64 - SLOTS)).view(np.int64)
        found = self.keys[at]
        out = np.where((found == key) & (a >= 0) & (b >= 0), self.codes[at], NONE)
        late = np.flatnonzero(((found != key) & (found >= 0) & (a >= 0) & (b >= 0)).ravel())
        key, at, flat = key.ravel(), at.ravel(), out.ravel()
        while len(late):
            at[late] = (at[late] + 1) % (1 << SLOTS)
            found = self.keys[at[late]]
            hit = found == key[late]
            flat[late[hit]] = self.codes[at[late[hit]]]
            late = late[~hit & (found >= 0)]
        return flat.reshape(out.shape)

    def many(self, words: list[str]) -> list[list[int]]:
        """The ids of many words: each step joins the first pair of least rank in each word that still has one."""
        raw = [w.encode() for w in words]
        out: list = [None] * len(words)
        by_width: dict[int, list[int]] = {}
        for i, r in enumerate(raw):
            if len(r) > LONG:
                out[i] = self.one(words[i])
            else:
                by_width.setdefault(-(-len(r) // 4) * 4, []).append(i)
        for width, rows in by_width.items():
            lens = np.array([len(raw[i]) for i in rows])
            flat = np.frombuffer(b"".join([raw[i].ljust(width, b"\0") for i in rows]), np.uint8).reshape(len(rows), width)
            at, every = self.inner[flat], np.arange(len(rows))
            at[every, lens - 1] = self.last[flat[every, lens - 1]]
            at = np.concatenate([np.where(np.arange(width) < lens[:, None], at, -1), np.full((len(rows), 1), -1)], 1)
            code = np.concatenate([self.codes_of(at[:, :-1], at[:, 1:]), np.full((len(rows), 1), NONE)], 1)
            live, done, k = every, np.full((len(rows), width + 1), -1), np.arange(width + 1)
            while len(live):
                r = np.arange(len(live))
                best = code.argmin(1)
                least = code[r, best]
                if (least == NONE).any():
                    ended = least == NONE
                    done[live[ended]] = at[ended]
                    live, at, code, best, least = (x[~ended] for x in (live, at, code, best, least))
                    if not len(live):
                        break
                    r = np.arange(len(live))
                take = np.minimum(k + (k > best[:, None]), width)
                at, code = np.take_along_axis(at, take, 1), np.take_along_axis(code, take, 1)
                at[r, best] = least & 0xFFFFF
                for side in (best - 1, best):
                    ok = np.flatnonzero((side >= 0) & (side < width))
                    x = side[ok]
                    code[ok, x] = self.codes_of(at[ok, x], at[ok, x + 1])
            for i, ids in zip(rows, done.tolist()):
                out[i] = ids[: ids.index(-1)]
        return out


@lru_cache(1)
def vocabulary(text: str) -> Vocabulary:
    """A worker's vocabulary lives on from task to task; what a task learns of words doesn't."""
    return Vocabulary(text)


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """A minimal acyclic transducer from words to places in the table of ids, as one block of arrays.

    Words come in order, so a state is final in shape as soon as a later word leaves it: it is then replaced by
    an equal state known already. The number on an arc is how many words sort before those that the arc leads to.
    """
    words = sorted(entries)
    known: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []  # (final, ((byte, target), ...))
    counts: list[int] = []

    def settle(node: list) -> int:
        shape = (node[0], tuple(node[1]))
        if shape not in known:
            known[shape] = len(states)
            states.append(shape)
            counts.append(shape[0] + sum(counts[t] for _, t in shape[1]))
        return known[shape]

    path, before = [[False, []]], b""
    for w in [*words, None]:
        same = 0
        if w is not None:
            while same < min(len(before), len(w)) and before[same] == w[same]:
                same += 1
        for i in range(len(before), same, -1):
            path[i - 1][1].append((before[i - 1], settle(path.pop())))
        if w is None:
            break
        path += [[False, []] for _ in range(len(w) - same)]
        path[-1][0], before = True, w
    root = settle(path[0])
    keys, targets, adds = [], [], []
    for s, (final, arcs) in enumerate(states):
        passed = int(final)
        for b, t in arcs:
            keys.append(s * 256 + b)
            targets.append(t)
            adds.append(passed)
            passed += counts[t]
    lists = [entries[w] for w in words]
    ids = np.array([i for x in lists for i in x], np.int64)
    ends = np.cumsum([0, *map(len, lists)])
    parts = [np.array(x, np.int64) for x in (keys, targets, adds)] + [np.array([f for f, _ in states], np.int64), ends, ids]
    head = np.array([root, len(parts), *map(len, parts)], np.int64)
    return b"".join(x.astype(np.int64).tobytes() for x in (head, *parts))


class Lexicon:
    """The compiled automaton, over memory-mapped arrays."""

    def __init__(self, path: str):
        raw = np.asarray(np.memmap(path, np.int64, "r"))  # a plain view of the mapped file
        self.root, at, parts = int(raw[0]), 2 + int(raw[1]), []
        for n in raw[2:at].tolist():
            parts.append(raw[at : at + n])
            at += n
        self.keys, self.targets, self.adds, self.final, self.ends, self.ids = parts

    def places(self, words: list[bytes]) -> np.ndarray:
        """Each word's place in the table, -1 for unknown words; all words take a step at a time."""
        out = np.full(len(words), -1, np.int64)
        if not len(self.keys) or not words:
            return out
        lens = np.array([len(w) for w in words])
        live = np.flatnonzero((lens > 0) & (lens <= LONG))
        if not len(live):
            return out
        width = int(lens[live].max())
        chars = np.frombuffer(b"".join(words[i].ljust(width, b"\0") for i in live), np.uint8).reshape(len(live), width)
        state, total = np.full(len(live), self.root, np.int64), np.zeros(len(live), np.int64)
        for k in range(width + 1):
            ended = lens[live] == k
            hit = ended & (self.final[state] == 1)
            out[live[hit]] = total[hit]
            key = state * 256 + chars[:, min(k, width - 1)]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            on = ~ended & (self.keys[arc] == key)
            live, chars, state, total = live[on], chars[on], self.targets[arc[on]], total[on] + self.adds[arc[on]]
            if not len(live):
                break
        return out


def pieces(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """What white space divides, of all texts one after the other, and where each text's pieces end."""
    whole = pa.array(texts, pa.large_string())
    if _WIDE.search("".join(texts)):
        whole = pc.replace_substring_regex(whole, _WIDE.pattern, " ")
    split = pc.ascii_split_whitespace(whole)
    flat, ends = split.flatten(), np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))
    some = pc.greater(pc.binary_length(flat), 0)  # white space at either end leaves an empty piece
    return flat.filter(some), np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])[ends]


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts: summed in each batch, then by Spark."""

    def f(_, texts):
        seen = pieces(texts)[0].value_counts()
        return seen.field("values").cast(pa.string()), seen.field("counts")

    return map_texts(docs, lambda: f, "word string, n long", rows=10_000, size=32 << 20).groupBy("word").agg(F.sum("n").alias("n"))


def _ship(spark, block: bytes) -> str:
    """Put a small file into the shared folder, through Hadoop's file system, and have Spark send it to every executor."""
    path = shared_path(spark, "lexicon") + ".bin"
    jvm = spark.sparkContext._jvm
    to = jvm.org.apache.hadoop.fs.Path(path)
    out = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(to, True)
    out.write(bytearray(block))
    out.close()
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[1]


def frequent(docs: DataFrame, size: int) -> list[str]:
    """The most frequent words that occur twice at least and aren't too long: as many as fit in whole classes of equal
    frequency. The classes are counted first, so no more than ``size`` words reach the driver."""
    counted = stage(word_counts(docs).where((F.col("n") > 1) & (F.octet_length("word") <= LONG)), "words")
    classes = counted.groupBy("n").count().orderBy(F.desc("n")).limit(size)  # a class has a word at least
    total, least = 0, None
    for r in classes.collect():
        total += r["count"]
        if total > size:
            break
        least = r.n
    return [] if least is None else sorted(r.word for r in counted.where(F.col("n") >= least).collect())


def build_lexicon(docs: DataFrame, vocab: str, size: int = LEXICON_SIZE) -> str:
    """Compile the most frequent words and ship the automaton; the name of its file."""
    v = vocabulary(vocab)
    words = frequent(docs, size)
    return _ship(docs.sparkSession, compile_lexicon({p.encode(): ids for p, ids in zip(words, v.pieces(words))}))


class Coder:
    """Encodes words: known ones from memory, else by the automaton, else by merging. Its memory is a task's, and holds
    the ids of each word as four bytes each."""

    def __init__(self, vocab: str, lexicon: str):
        self.v, self.lexicon = vocabulary(vocab), Lexicon(SparkFiles.get(lexicon))
        self.number = pa.array(self.v.number, pa.large_string())
        self.token = pa.array([self.v.tokens.get(i, "") for i in range(len(self.v.number))], pa.large_string())
        self.known: dict[str, bytes] = {}

    def learn(self, new: list[str]) -> None:
        places = self.lexicon.places([p.encode() for p in new])
        listed = np.flatnonzero(places >= 0)
        starts, ends = (self.lexicon.ends[places[listed] + k] for k in (0, 1))
        flat = self.lexicon.ids[_ranges(starts, ends - starts)].astype(np.int32).tobytes()
        at = 0
        for i, n in zip(listed.tolist(), (4 * (ends - starts)).tolist()):
            self.known[new[i]] = flat[at : at + n]
            at += n
        rest = [new[i] for i in np.flatnonzero(places < 0).tolist()]
        self.known.update(zip(rest, [array("i", ids).tobytes() for ids in self.v.pieces(rest)]))

    def encode(self, texts: list[str]) -> tuple[list[int], list[bytes], list[bytes]]:
        """Of each text the number of its tokens, its ids joined by single spaces, and its decoded text, both in UTF-8."""
        flat, ends = pieces(texts)
        coded = flat.dictionary_encode()
        here, places = coded.dictionary.to_pylist(), coded.indices
        if len(self.known) + len(here) > REMEMBERED:
            self.known = {p: self.known[p] for p in here if p in self.known}
        if new := [p for p in here if p not in self.known]:
            self.learn(new)
        packed = [self.known[p] for p in here]
        ids, lens = pa.array(np.frombuffer(b"".join(packed), np.int32)), np.array([len(x) >> 2 for x in packed], np.int64)
        words, rows = _offsets(lens.cumsum()), _offsets(ends)

        def told(names: pa.Array) -> list[bytes]:
            return _joined(rows, _joined(words, names.take(ids)).take(places)).cast(pa.large_binary()).to_pylist()

        n = np.diff(np.concatenate([[0], lens[places.to_numpy()].cumsum()])[rows.to_numpy()])
        return n.tolist(), told(self.number), told(self.token)


def _ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its length says, one after the other."""
    return np.arange(lens.sum()) - np.repeat(lens.cumsum() - lens, lens) + np.repeat(starts, lens)


def _offsets(ends: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], ends]), pa.int64())


def _joined(offsets: pa.Array, values: pa.Array) -> pa.Array:
    return pc.binary_join(pa.LargeListArray.from_arrays(offsets, values), pa.scalar(" ", pa.large_string()))


def encode(docs: DataFrame, vocab_path: str, lexicon_size: int = LEXICON_SIZE, keep: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), and with ``keep`` ids (space-joined) and decoded text.

    Digests are those of the decimal ids joined by one space, and of the decoded text in UTF-8. Null and empty
    texts have no tokens. Repeated rows give repeated results.
    """
    with open(vocab_path, encoding="utf-8") as f:
        vocab = f.read()
    docs = texts_of(docs)
    lexicon = build_lexicon(docs, vocab, lexicon_size)
    sent = docs.sparkSession.sparkContext.broadcast(vocab)

    def make():
        coder = Coder(sent.value, lexicon)

        def f(doc_ids, texts):
            n, ids, shown = coder.encode(texts)
            digests = ([hashlib.sha256(x).hexdigest() for x in told] for told in (ids, shown))
            return (doc_ids, n, *digests, *([x.decode() for x in told] for told in (ids, shown))) if keep else (doc_ids, n, *digests)

        return f

    return map_texts(docs, make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids string, decoded string" * keep)


def decode(rows: DataFrame, vocab_path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids): tokens joined by one space, as for a file without a decoder. Null ids: empty."""
    with open(vocab_path, encoding="utf-8") as f:
        vocab = f.read()
    sent = rows.sparkSession.sparkContext.broadcast(vocab)

    def make():
        tokens = vocabulary(sent.value).shown
        return lambda doc_ids, ids: (doc_ids, [" ".join([tokens[i] for i in x.split()]) for x in ids])

    return map_texts(rows.select("doc_id", F.col("ids").alias("text")), make, "doc_id long, text string")
