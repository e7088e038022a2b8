"""Quality rules as weak supervision: rules vote or abstain, and their votes are weighed by learned accuracies.

Base figures are counted over whole texts. Each rule says 1 (good), 0 (bad) or nothing. The votes of all documents
are counted by pattern, which is at most 3 to the number of rules rows however many documents there are, and
expectation-maximisation over these counts estimates how often each rule says what of good and of bad documents.
A document stays if its posterior probability of being good is high enough.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, map_texts, stage

MIN_POSTERIOR = 0.5
MIN_WORDS = 50
MAX_REPEAT_SHARE = 50  # per cent
SYMBOLS = "#*$%&|<>"
#: Frequent function words.
COMMON = frozenset(b"the of and to in is that for it was on with as be at by this are or de la le les des et en un une est que pour dans el los las del y por con para der die das und ist von zu den mit auf ein eine nicht".split())


def figures(text: str) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, then n_common, n_upper, n_lines, n_ended, n_odd, n_distinct."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    if not n:
        return (0,) * 11
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    dup = lines = ended = 0
    seen = set()
    for line in raw.split(b"\n") if b"\n" in raw else (raw,):
        if line.split(None, 1):
            dup += line in seen
            seen.add(line)
            lines += 1
            ended += line.rstrip()[-1:] in (b".", b"!", b"?", b":", b'"')
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    repeat = 0
    if n > 3:
        windows = (ids[:-2] * len(number) + ids[1:-1]) if len(number) < 2**20 else None
        pair = np.unique(windows, return_inverse=True)[1] if windows is not None else np.unique(np.stack([ids[:-2], ids[1:-1]], 1), axis=0, return_inverse=True)[1].ravel()
        _, back, counts = np.unique(pair * len(number) + ids[2:], return_inverse=True, return_counts=True)
        again = counts[back] > 1
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : k + n - 2] |= again
        repeat = int(covered.sum())
    odd = sum(not w[-1:].isalnum() and not w[-1] > 127 and w[-1:] not in b".,;:!?)\"'" or w[-2:] == b"!!" for w in number)
    held = Counter(ids.tolist()) if odd else {}
    n_odd = sum(held[i] for w, i in number.items() if not w[-1:].isalnum() and not w[-1] > 127 and w[-1:] not in b".,;:!?)\"'" or w[-2:] == b"!!") if odd else 0
    return n, chars, symbols, dup, repeat, sum(map(COMMON.__contains__, map(bytes.lower, words))), sum(map(str.isupper, text)), lines, ended, n_odd, len(number)


def votes(x: tuple[int, ...]) -> str:
    """One letter for each rule: g good, b bad, - no vote."""
    n, chars, symbols, dup, repeat, common, upper, lines, ended, odd, distinct = x
    say = lambda bad, good: "b" if bad else "g" if good else "-"
    share = lambda k, of: k / of if of else 0.0
    return "".join((
        say(n < 50, n >= 100),
        say(not 2 <= share(chars, n) <= 14, 3 <= share(chars, n) <= 10),
        say(share(symbols, n) > 0.1, share(symbols, n) < 0.02),
        say(share(dup, lines) > 0.3, False),
        say(share(repeat, n) > 0.5, share(repeat, n) < 0.2),
        say(share(common, n) < 0.03, share(common, n) > 0.1),
        say(share(upper, chars) > 0.4, share(upper, chars) < 0.15),
        say(False, share(ended, lines) > 0.5),
        say(share(odd, n) > 0.3, share(odd, n) < 0.05),
        say(n >= 50 and share(distinct, math.sqrt(n)) < 1.5, n < 2000 and share(distinct, n) > 0.4),
    ))


def learn(counts: dict[str, int], rounds: int = 60) -> tuple[float, np.ndarray]:
    """(prior, chance[class, rule, said]) by expectation-maximisation; said is 0 bad, 1 good, 2 nothing.

    Starts from a rule being right four times in five, with the add-one counts of one document of each kind.
    """
    if not counts:
        return 0.8, np.zeros((2, 0, 3))
    said = np.array([["bg-".index(c) for c in k] for k in counts])
    weight = np.array(list(counts.values()), float)
    prior = 0.8
    chance = np.tile(np.array([[0.6, 0.15, 0.25], [0.05, 0.6, 0.35]])[:, None, :], (1, said.shape[1], 1))
    for _ in range(rounds):
        good = posterior(said, prior, chance) * weight
        parts = np.stack([weight - good, good])
        prior = (good.sum() + 1) / (weight.sum() + 2)
        for k in range(3):
            chance[:, :, k] = parts @ (said == k) + 1
        chance /= chance.sum(2, keepdims=True)
    return prior, chance


def posterior(said: np.ndarray, prior: float, chance: np.ndarray) -> np.ndarray:
    """A rule's silence is no evidence: only what is said counts, so nothing shifts for abstaining."""
    spoke = said < 2
    heard = np.log(chance[:, :, :2] / chance[:, :, :2].sum(2, keepdims=True))
    r = np.arange(said.shape[1])
    at = [np.where(spoke, heard[c, r[None], np.minimum(said, 1)], 0).sum(1) for c in (0, 1)]
    return 1 / (1 + np.exp(np.clip(at[0] - at[1] + math.log((1 - prior) / prior), -700, 700)))


def judge(docs: DataFrame, min_posterior: float = MIN_POSTERIOR) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, votes, posterior).

    A row for each row of docs. Texts without words have zeros everywhere and fail. The posterior depends on the
    votes alone, so equal texts are judged alike, in any order.
    """
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def f(ids, texts):
        rows = [figures(t) for t in texts]
        return (ids, *([r[i] for r in rows] for i in range(5)), [votes(r) for r in rows])

    counted = stage(map_texts(docs, lambda: f, "doc_id long, " + ", ".join(f"{c} long" for c in base) + ", votes string"), "figures")
    patterns = {r.votes: r["count"] for r in counted.groupBy("votes").count().collect()}
    prior, chance = learn(patterns)
    good = posterior(np.array([["bg-".index(c) for c in k] for k in patterns]), prior, chance).tolist() if patterns else []
    judged = docs.sparkSession.createDataFrame(list(zip(patterns, good)), "votes string, posterior double")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_SHARE * F.col("n_words"))
    return (
        counted.join(F.broadcast(judged), "votes")  # at most 3**10 short rows
        .withColumn("base_failed", failed)
        .select("doc_id", *base, "base_failed", (~F.col("base_failed") & (F.col("posterior") >= min_posterior)).alias("kept"), "votes", "posterior")
    )
