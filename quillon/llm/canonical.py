"""Mapping freely typed values to the entries of a reference list; values that mean no entry are reported.

A multi-pattern automaton over the entries' names and aliases finds embedded mentions and keeps the longest that don't
overlap. A mention decides when nothing else in the value speaks for another entry. All other values go to token-set
similarity, where each word of an entry is matched to its nearest word of the value: equal, abbreviated or misspelled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.spelling import NearWords, abbreviates, distance, plain, spaced

#: Entries that a reference list may have: lists are sent to every worker, larger ones are refused.
MOST_ENTRIES = 200_000
#: Values remembered per worker.
MEMORY = 200_000


@dataclass(frozen=True)
class Kind:
    """How values of one list are written. All are fixed values or parameters, none is fitted to a table."""

    #: Words that stand for others: alias to its full words.
    aliases: dict[str, str] = field(default_factory=dict)
    #: Words that carry no meaning in a value.
    noise: frozenset[str] = frozenset()
    #: Whether initials of entries with two or more words are aliases of theirs.
    acronyms: bool = False
    #: Whether an entry's first word names it alone where no other entry begins with it.
    head_names: bool = False
    #: Whether an entry's last words only tell apart entries with the same name ("City, Region").
    tail_optional: bool = False


TITLES = Kind(
    aliases={
        "vp": "vice president", "svp": "senior vice president", "sr": "senior", "snr": "senior", "jr": "junior", "jnr": "junior",
        "ml": "machine learning", "sre": "site reliability engineer", "swe": "software engineer", "hr": "people",
        "cofounder": "co founder", "sw": "software", "hw": "hardware", "postdoc": "postdoctoral fellow", "ops": "operations", "mktg": "marketing", "mkt": "marketing", "biz": "business",
    },
    noise=frozenset("of the and in at on a an part time contract interim leave work emea apac amer americas uk us eu global acting remote freelance currently now level grade i ii iii investments team".split()),
    acronyms=True,
)
COMPANIES = Kind(
    noise=frozenset("the ex inc llc ltd gmbh ag plc sa corp co limited company corporation kg bv nv oy ab spa srl acquired former formerly".split()),
    head_names=True,
)
PLACES = Kind(
    aliases={"pt": "port", "st": "saint", "ft": "fort", "mt": "mount", "mtn": "mount"},
    noise=frozenset("greater area metro metropolitan region near remote and city of around outside based".split()),
    tail_optional=True,
)


def words_of(value: str) -> tuple[str, ...]:
    """Words of a value: plain lower case letters and digits; dotted initials are one word."""
    text = spaced(plain(value.strip())).lower()
    text = re.sub(r"\b([a-z])/([a-z])\b", r"\1\2", text)
    text = re.sub(r"\b((?:[a-z]\.){2,})", lambda m: m[1].replace(".", "") + " ", text)
    return tuple(re.findall(r"[a-z0-9]+", text.replace("'", "")))


class Mapper:
    """One reference list, compiled. ``entries`` are (id, name, extra words that name the tail as well)."""

    def __init__(self, entries: list[tuple[str, str, str | None]], kind: Kind):
        import ahocorasick

        if len(entries) > MOST_ENTRIES:
            raise ValueError(f"{len(entries)} entries; this way of mapping takes at most {MOST_ENTRIES}")
        self.kind = kind
        self.exact = {name for _, name, _ in entries}
        self.ids: list[str] = []
        self.words: list[tuple[str, ...]] = []
        self.tails: list[frozenset[str]] = []
        automaton = ahocorasick.Automaton()
        patterns: dict[str, set[int]] = {}
        heads: Counter = Counter()
        acronyms: dict[str, set[int]] = {}
        for i, (eid, name, extra) in enumerate(sorted(entries, key=lambda e: (e[0], e[1]))):
            words = words_of(name)
            self.ids.append(eid)
            tail: frozenset[str] = frozenset()
            if kind.tail_optional:
                head, _, rest = name.rpartition(",")
                words = words_of(head) or words
                tail = frozenset(words_of(rest)) | frozenset(words_of(extra or ""))
            self.words.append(words)
            self.tails.append(tail)
            heads[words[0] if words else ""] += 1
            patterns.setdefault(" ".join(words), set()).add(i)
            for initials in {"".join(w[0] for w in words), "".join(w[0] for w in words if w not in kind.noise)}:
                if kind.acronyms and len(initials) > 1:
                    acronyms.setdefault(initials, set()).add(i)
        self.heads = heads
        self.known = {w for ws in self.words for w in ws} | {w for t in self.tails for w in t}
        self.acronyms = {a: next(iter(e)) for a, e in acronyms.items() if len(e) == 1 and a not in self.known}
        for a, i in self.acronyms.items():
            patterns.setdefault(a, set()).add(i)
        for pattern, who in patterns.items():
            if pattern:
                automaton.add_word(f" {pattern} ", (len(pattern), tuple(sorted(who))))
        automaton.add_word("\0", (0, ()))  # an empty list still needs an automaton
        automaton.make_automaton()
        self.automaton = automaton
        self.near = NearWords({w for w in self.known if len(w) >= 4})
        self.by_word: dict[str, list[int]] = {}
        for i, ws in enumerate(self.words):
            for w in set(ws):
                self.by_word.setdefault(w, []).append(i)
        self.compact = {"".join(ws): i for i, ws in enumerate(self.words) if len(ws) > 1}
        self.tail_words = {w for t in self.tails for w in t}
        # Words by their first letters, by first letter and any other, and names by their first and last letters: what a value's
        # words are compared with is looked up and never all of the list.
        self.starting: dict[str, list[str]] = {}
        self.holding: dict[tuple[str, str], list[str]] = {}
        for w in self.known:
            for prefix in {w[:1], w[:2]} | ({w[:5]} if len(w) >= 6 else set()):
                self.starting.setdefault(prefix, []).append(w)
            for letter in set(w):
                self.holding.setdefault((w[0], letter), []).append(w)
        self.ends: dict[tuple[str, str], list[str]] = {}
        for c in self.compact:
            self.ends.setdefault(("first", c[:3]), []).append(c)
            self.ends.setdefault(("last", c[-3:]), []).append(c)
        self.like = lru_cache(maxsize=MEMORY)(self._like)
        self.find = lru_cache(maxsize=MEMORY)(self._find)

    def _like(self, word: str) -> dict[str, float]:
        """Words of the list that ``word`` may mean, with their similarity."""
        if word in self.known:
            out = {word: 1.0}
        else:
            out = {}
            for w, d in self.near.near(word) if len(word) >= 3 else ():
                if d <= (1 if len(w) < 8 else 2):
                    out[w] = 1 - d / max(len(w), len(word)) * (1.0 if d < 2 else 1.3)
        if len(word) < 9:
            for w in self._longer(word):
                if w != word and w not in out and abbreviates(word, w):
                    out[w] = 0.85 if w.startswith(word) else 0.8
            for w in self.starting.get(word[:5], ()) if len(word) >= 6 else ():
                if w not in out and len(w) >= 6:
                    out[w] = 0.7
        return out

    def _longer(self, word: str) -> list[str]:
        """Words of the list that ``word`` may abbreviate: those with its first letters, or with its first and its rarest letter."""
        if len(word) < 3:
            return self.starting.get(word, [])
        return min((self.holding.get((word[0], c), []) for c in word), key=len)

    def mentions(self, words: tuple[str, ...]) -> list[tuple[int, int, tuple[int, ...]]]:
        """Longest non-overlapping (start, end, entries) of the list's names within the words."""
        joined = " " + " ".join(words) + " "
        starts, position = {}, 0
        for i, w in enumerate(words):
            starts[position] = i
            position += len(w) + 1
        found = []
        for end, (length, who) in self.automaton.iter(joined.replace("\0", " ")):
            first = starts[end - length - 1]
            count = joined[end - length - 1 : end].count(" ")
            found.append((first, first + count, who))
        found.sort(key=lambda f: (f[0] - f[1], f[0]))
        taken: set[int] = set()
        kept = []
        for s, e, who in found:
            if not taken & set(range(s, e)):
                taken |= set(range(s, e))
                kept.append((s, e, who))
        return kept

    def _of_tail(self, who: tuple[int, ...] | list[int], rest: list[str]) -> list[int]:
        """Those of ``who`` whose tail agrees with what the value says of it; all of them if it says nothing."""
        said = [w for w in rest if w in self.tail_words] if self.kind.tail_optional else []
        if not said:
            return list(who)
        return [i for i in who if all(w in self.tails[i] for w in said)]

    def _score(self, i: int, words: tuple[str, ...], likes: list[dict[str, float]]) -> float:
        entry = self.words[i]
        left = list(range(len(words)))
        got, spent = [], 0.0
        for w in sorted(entry, key=lambda w: -max((k.get(w, 0) for k in likes), default=0)):
            best = max(left, key=lambda j: likes[j].get(w, 0), default=None)
            sim = likes[best].get(w, 0) if best is not None else 0
            if sim:
                left.remove(best)
                spent += 1
            got.append((w, sim))
        weight = lambda w: 0.3 if w in self.kind.noise else 1.0
        whole = sum(weight(w) for w in entry)
        covered = sum(weight(w) * s for w, s in got) / whole
        extra = [words[j] for j in left if words[j] not in self.kind.noise and words[j] not in self.tails[i]]
        speaks = sum(1.0 if likes[j] else 0.6 for j in left if words[j] in extra)
        return covered - 0.12 * speaks

    def _find(self, value: str) -> str:
        """Id of the entry that a value means, '' for none."""
        words = words_of(value)
        if not words:
            return ""
        forms = [words]
        if re.search(r"[a-zA-Z]\.[a-zA-Z]", value):
            forms.append(words_of(re.sub(r"(?<=[a-zA-Z])\.(?=[a-zA-Z])", "", value)))
        best = ("", 0.0)
        for form in forms:
            found = self._decide(form)
            if found[1] > best[1]:
                best = found
        return best[0]

    def _expand(self, words: tuple[str, ...]) -> tuple[str, ...]:
        return tuple(x for w in words for x in (self.kind.aliases[w].split() if w in self.kind.aliases and w not in self.known else [w]))

    def _decide(self, raw: tuple[str, ...]) -> tuple[str, float]:
        kind = self.kind
        words = self._expand(raw)
        found = self.mentions(words)
        if len(found) == 1:
            s, e, who = found[0]
            rest = [w for w in (*words[:s], *words[e:]) if w not in kind.noise]
            tails = [w for w in rest if w in self.tail_words]
            if all(w in tails or not self.like(w) for w in rest):
                who = self._of_tail(who, rest)
                if len(who) == 1:
                    return self.ids[who[0]], 2.0
                if len(who) > 1:
                    return "", 1.5
        if kind.head_names:
            return self._decide_head(words)
        likes = [self.like(w) for w in words]
        voted: Counter = Counter()
        for k in likes:
            for w in k:
                for i in self.by_word.get(w, ()):
                    voted[i] += 1
        scored = sorted(((self._score(i, words, likes), i) for i in voted), reverse=True)
        if kind.tail_optional and scored:
            top = scored[0][0]
            keep = self._of_tail([i for s, i in scored if s >= top - 0.02], list(words))
            scored = [(s, i) for s, i in scored if i in keep or s < top - 0.02]
        if scored and scored[0][0] >= 0.72 and (len(scored) == 1 or scored[0][0] > scored[1][0] + 1e-9):
            return self.ids[scored[0][1]], scored[0][0]
        whole = "".join(words)
        if whole in self.compact:
            return self.ids[self.compact[whole]], 1.0
        return "", 0.0

    def _decide_head(self, words: tuple[str, ...]) -> tuple[str, float]:
        """Entries named by their first word, the others telling apart those that share it."""
        said = [w for w in words if w not in self.kind.noise]
        if not said:
            return "", 0.0
        scored = []
        likes = {w: self.like(w) for w in said}
        for j, w in enumerate(said):
            rest = said[:j] + said[j + 1 :]
            for head, sim in likes[w].items():
                if sim < 0.7 or head not in self.heads or (len(w) < 4 and w != head):
                    continue
                for i in self.by_word.get(head, ()):
                    if self.words[i][0] != head:
                        continue
                    tail = self.words[i][1:]
                    met = [max((self.like(r).get(t, 0) for r in rest), default=0) for t in tail]
                    strangers = [r for r in rest if not any(self.like(r).get(t, 0) for t in tail)]
                    share = sum(met) / len(tail) if tail else 1.0
                    if strangers:
                        score = 0.0
                    elif not rest:
                        score = sim if self.heads[head] == 1 else 0.0
                    else:
                        score = sim + (1.0 if met and met[0] else share)
                    scored.append((score, share, i))
        scored.sort(reverse=True)
        if scored and scored[0][0] >= 0.7 and (len(scored) == 1 or scored[0][:2] > scored[1][:2]):
            return self.ids[scored[0][2]], scored[0][0]
        whole = "".join(said)
        close = {*self.ends.get(("first", whole[:3]), ()), *self.ends.get(("last", whole[-3:]), ())}
        near = [(distance(whole, c), self.compact[c]) for c in close if abs(len(c) - len(whole)) <= 1]
        near.sort()
        if len(said) == 1 and near and near[0][0] <= 1 and (len(near) == 1 or near[1][0] > near[0][0]):
            return self.ids[near[0][1]], 1.0
        return "", 0.0


def read_list(df: DataFrame, key: str, name: str, extra: str | None = None) -> list[tuple[str, str, str | None]]:
    """A reference list on the driver, its size proven first; repeated rows and rows with a null id or name are left out."""
    rows = df.select(F.col(key).cast("string"), F.col(name).cast("string"), (F.col(extra) if extra else F.lit(None)).cast("string"))
    rows = rows.filter(rows[0].isNotNull() & rows[1].isNotNull()).distinct().limit(MOST_ENTRIES + 1).collect()
    if len(rows) > MOST_ENTRIES:
        raise ValueError(f"the reference list has more than {MOST_ENTRIES} entries")
    return [tuple(r) for r in rows]


_COMPILED: dict[str, Mapper] = {}


def mapper(name: str, entries: list, kind: Kind) -> Mapper:
    """One compiled list per Python worker."""
    import hashlib
    import pickle

    key = f"{name}-{hashlib.md5(pickle.dumps(entries)).hexdigest()}"
    if key not in _COMPILED:
        _COMPILED[key] = Mapper(entries, kind)
    return _COMPILED[key]


def map_profiles(df: DataFrame, key: str, raw: str, lists: dict[str, tuple[list, Kind]]) -> DataFrame:
    """(key, field, ref_id) of every non-blank profile value that isn't exactly an entry of its list.

    One narrow pass: JSON is read, the values of ``lists``' fields are mapped and remembered per worker, nothing is
    shuffled. ref_id is '' where no entry is meant, several could be, or the value holds no letters. Unreadable or
    null JSON and values that are no text give no rows.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        from quillon.operators.nested import profile_of, read_object

        use = [(f, m := mapper(f, entries, k), m.exact) for f, (entries, k) in lists.items()]
        for batch in batches:
            out = []
            for rid, text in zip(batch[key], batch[raw]):
                if (record := read_object(text)) is None:
                    continue
                profile = profile_of(record)
                for f, m, exact in use:
                    v = profile.get(f)
                    if isinstance(v, str) and v not in exact and v.strip():
                        out.append((rid, f, m.find(v)))
            yield pd.DataFrame(out, columns=[key, "field", "ref_id"])

    return df.select(key, raw).filter(F.col(raw).isNotNull()).mapInPandas(run, f"`{key}` {kind}, field string, ref_id string")
