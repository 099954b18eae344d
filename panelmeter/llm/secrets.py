"""Secrets in whole texts: three fixed kinds, and credentials by learned formats.

The fixed kinds are regular expressions, leftmost and without overlap, of which
matches that are too short are dropped. What they leave of every run of token signs is
searched for credentials by probabilistic automata, one per labelled format. A candidate
is any 16 or more signs of a run that begin at its start, after a mark or at a format's
common beginning, and end at its end or before a mark; the labelled formats have 20 signs
or more. An automaton is inferred from labelled credentials: their prefix tree,
in which two states become one when the frequencies of ending, of every next sign and of
every remaining length differ by no more than Hoeffding's bound allows (red and blue
states). A state first looks for its like at its own place in the word, where little
evidence is enough to merge; states at different places need to be much alike, so lengths
and separators stay in the automaton. A format's common beginning stays literal; other
signs stand for their class, spread evenly over it. Where many credentials passed, a sign
that none had costs about 90 bits, an end that none had is ruled out, and so is any sign
where all ended. A candidate counts when the best automaton makes it LEAST_BITS bits a sign
likelier than the models of ordinary strings, of which each part between marks may take
another; its score is the bits above that. Cutting next to a mark that the format itself
may hold costs INNER_BITS, so a credential with such marks stays whole; marks that trail
a run are cut free. Of the candidates that count those without overlap with the highest
sum of scores are reported as kind `format`.

Null texts are empty. Positions count code points; ends are exclusive. Rows are
independent, so repeated rows repeat their result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_right
from collections import Counter, defaultdict, deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import pick
from .words import frugal

KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{16,}")     # the same spans as HEX of 16 or more
SHORTEST = 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
PART = re.compile(r"[A-Za-z0-9]+|[^A-Za-z0-9]+")
LEAST_BITS = 0.75
INNER_BITS = 6
#: visits that a sign is given in a state of an ordinary kind which never saw it
UNSEEN = 1e-4
#: the same at a place of ENOUGH visits or more of a format; nothing ends there if no example did
FOREIGN = 1e-24
ENOUGH = 50
#: visits that the signs of all places are given at a place of fewer
SHARED = 2
ALPHA = 0.05
#: Hoeffding's alpha for states at one place and at different places: lower merges sooner
WITHIN, ACROSS = 0.001, 1.0
PER_FORMAT = 1000
SEED = 23

DIGITS, LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
UPPER, MARKS = LOWER.upper(), "+/_.=-"
CLASSES = {"d": DIGITS, "f": "abcdef", "l": "ghijklmnopqrstuvwxyz", "F": "ABCDEF", "L": "GHIJKLMNOPQRSTUVWXYZ"}
CLASS_OF = {c: k for k, signs in CLASSES.items() for c in signs} | {c: c for c in MARKS}
SPREAD = {k: len(v) for k, v in CLASSES.items()} | {c: 1 for c in MARKS}

# Labelled formats: a beginning, then runs of signs (alphabet, shortest, longest).
FORMATS = {
    "cloud_key": ("AKIA", [(UPPER + DIGITS, 16, 16)]),
    "cloud_secret": ("", [(UPPER + LOWER + DIGITS + "+/", 40, 40)]),
    "hex_token": ("", [("abcdef" + DIGITS, 32, 32)]),
    "long_hex_token": ("", [("abcdef" + DIGITS, 64, 64)]),
    "upper_hex_token": ("", [("ABCDEF" + DIGITS, 32, 40)]),
    "forge_token": ("ghp_", [(UPPER + LOWER + DIGITS, 36, 36)]),
    "service_key": ("sk-", [(UPPER + LOWER + DIGITS, 40, 48)]),
    "chat_token": ("xoxb-", [(DIGITS, 11, 12), ("-", 1, 1), (UPPER + LOWER + DIGITS, 24, 24)]),
    "web_token": ("eyJ", [(UPPER + LOWER + DIGITS, 17, 33), (".", 1, 1), ("e", 1, 1), (UPPER + LOWER + DIGITS, 40, 60),
                          (".", 1, 1), (UPPER + LOWER + DIGITS + "_-", 43, 43)]),
    "base64_secret": ("", [(UPPER + LOWER + DIGITS + "+/", 42, 43), ("=", 1, 2)]),
}
# Labelled strings that look random and are no secrets, in the same form: hard to tell from credentials.
HARMLESS = {
    "content_hash": ("Qm", [(DIGITS[1:] + UPPER.replace("I", "").replace("O", "") + LOWER.replace("l", ""), 44, 44)]),
    "commit": ("", [("abcdef" + DIGITS, 40, 40)]),
    "identifier": ("", [("abcdef" + DIGITS, 8, 8), *[("-", 1, 1), ("abcdef" + DIGITS, 4, 4)] * 3, ("-", 1, 1),
                        ("abcdef" + DIGITS, 12, 12)]),
    "video_link": ("", [(UPPER + LOWER + DIGITS + "_-", 11, 11)]),
    "short_link": ("", [(UPPER + LOWER + DIGITS, 22, 22)]),
}
# Labelled ordinary strings of token signs, by kind.
ORDINARY = {
    "word": "the information internationalisation geschwindigkeitsbegrenzung responsabilidad "
            "anticonstitutionnellement lorem ipsum dolor library garden mountain weather".split(),
    "number": "1234567890 9780306406157 4929348385146306 20240131 0049301234567 31415926535897932384".split(),
    "date": "2024-01-31 2023-12-05 1999-07-14 2024-01-31 2011-11-11 10-12-2024".split(),
    "name": "Information December Section Report Geschwindigkeit Library Mountain Garden".split(),
    "path": "www.example.com index.html mail.example.org example.com/path/to/page.html a/b/c/d/e/f "
            "setup.cfg module.function_name report_final_2.txt photo_0001.jpeg".split(),
    "constant": "INFORMATION INTERNATIONALISATION HTTP_ACCEPT_LANGUAGE MAX_BUFFER_SIZE CHAPTER SECTION "
                "UNIVERSAL-DECLARATION GESCHWINDIGKEIT LIBRARY MOUNTAIN DEFAULT_CONFIGURATION_PATH".split(),
    "rule": "---------------- ================ ++++++++++++++++ ________________ //////////////// ................ "
            "-=-=-=-=-=-=-=-= +----------+----------+ ====---- ....".split(),
    "phrase": "read-only well-known state-of-the-art lorem-ipsum-dolor-sit-amet background-color user_name_field "
              "this-is-a-slug-with-words the-and-that-with chapter-12.section-3".split(),
}

APART = ("constant", "rule")


def drawn(kinds: dict[str, tuple], each: int, seed: int) -> list[tuple[str, str]]:
    """(kind, text) rows, drawn from the kinds by a seeded rule."""
    rng, out = random.Random(seed), []
    for name, (start, runs) in kinds.items():
        for _ in range(each):
            out.append((name, start + "".join(
                "".join(rng.choice(signs) for _ in range(rng.randint(low, high))) for signs, low, high in runs)))
    return out


def labelled_credentials(per_format: int = PER_FORMAT, seed: int = SEED) -> list[tuple[str, str]]:
    """(format, credential) rows of the labelled formats."""
    return drawn(FORMATS, per_format, seed)


class Automaton:
    """A probabilistic automaton over sign classes, by merging prefix-tree states.

    places: whether states tell apart how much of a word is still to come. Ordinary
    kinds, whose words have any length, do without.
    """

    def __init__(self, words: list[str], places: bool = True, alpha: float = ALPHA):
        first, last = min(words), max(words)
        same = next((i for i, (a, b) in enumerate(zip(first, last)) if a != b), min(len(first), len(last)))
        self.start = first[:same]
        self.places, self.alpha = places, alpha
        # state -> visits, endings, sign -> [visits, next state], place, signs to come -> visits
        self.visits, self.ends, self.moves, self.place, self.ahead = [0], [0], [{}], [0], [{}]
        for word in words:
            at, left = 0, len(word) - same
            self._visit(0, left)
            for sign in map(CLASS_OF.__getitem__, word[same:]):
                if sign not in self.moves[at]:
                    self.moves[at][sign] = [0, len(self.visits)]
                    self.visits.append(0)
                    self.ends.append(0)
                    self.moves.append({})
                    self.place.append(self.place[at] + 1)
                    self.ahead.append({})
                self.moves[at][sign][0] += 1
                at, left = self.moves[at][sign][1], left - 1
                self._visit(at, left)
            self.ends[at] += 1
        self._merge()
        self._log = self._placed() if places else self._likelihoods()
        self.seen = {sign for s in self.states for sign in self.moves[s]}
        self._hope = {}
        # the tree has done its work and does not travel to the tasks
        del self.visits, self.ends, self.moves, self.place, self.ahead

    def _visit(self, state: int, left: int):
        self.visits[state] += 1
        self.ahead[state][left] = self.ahead[state].get(left, 0) + 1

    @staticmethod
    def _bound(n: int, m: int, alpha: float) -> float:
        return (math.sqrt(1 / n) + math.sqrt(1 / m)) * math.sqrt(math.log(2 / alpha) / 2)

    def _as_long(self, a: int, b: int, alpha: float) -> bool:
        """Whether the signs to come are as many, by the largest distance of the distributions."""
        n, m = self.visits[a], self.visits[b]
        bound, x, y = self._bound(n, m, alpha), 0, 0
        for left in sorted(self.ahead[a].keys() | self.ahead[b].keys()):
            x += self.ahead[a].get(left, 0)
            y += self.ahead[b].get(left, 0)
            if abs(x / n - y / m) > bound:
                return False
        return True

    def _compatible(self, a: int, b: int, alpha: float) -> bool:
        if self.places and not self._as_long(a, b, alpha):
            return False
        todo = deque([(a, b)])
        while todo:
            a, b = todo.popleft()
            n, m = self.visits[a], self.visits[b]
            bound = self._bound(n, m, alpha)
            if abs(self.ends[a] / n - self.ends[b] / m) > bound:
                return False
            for sign in self.moves[a].keys() | self.moves[b].keys():
                x, y = self.moves[a].get(sign, (0, None)), self.moves[b].get(sign, (0, None))
                if abs(x[0] / n - y[0] / m) > bound:
                    return False
                if x[1] is not None and y[1] is not None:
                    todo.append((x[1], y[1]))
        return True

    def _fold(self, red: int, blue: int):
        """Add the tree under blue to red."""
        todo = deque([(red, blue)])
        while todo:
            a, b = todo.popleft()
            self.visits[a] += self.visits[b]
            self.ends[a] += self.ends[b]
            for left, n in self.ahead[b].items():
                self.ahead[a][left] = self.ahead[a].get(left, 0) + n
            for sign, (n, target) in self.moves[b].items():
                own = self.moves[a].get(sign)
                if own is None:
                    self.moves[a][sign] = [n, target]
                else:
                    own[0] += n
                    todo.append((own[1], target))

    def _merge(self):
        red = {0: None}                     # in the order of becoming red
        while True:
            blue = [(s, sign, m[1]) for s in red for sign, m in sorted(self.moves[s].items()) if m[1] not in red]
            if not blue:
                break
            parent, sign, state = max(blue, key=lambda x: (self.visits[x[2]], -x[2]))
            place = self.place[state]
            for r in sorted(red, key=lambda r: self.places and self.place[r] != place):
                alpha = self.alpha if not self.places else WITHIN if self.place[r] == place else ACROSS
                if self._compatible(r, state, alpha):
                    self.moves[parent][sign][1] = r
                    self._fold(r, state)
                    break
            else:
                red[state] = None
        self.states = list(red)

    def _likelihoods(self):
        """state -> sign -> (log2 probability of one sign of the class, next state); None: ending.

        A sign that a state never saw leaves the state as it is.
        """
        out = {}
        for s in self.states:
            moves = self.moves[s]
            whole = self.visits[s] + 0.5 * (len(moves) + 1) + UNSEEN * (len(SPREAD) - len(moves))
            out[s] = {sign: (math.log2((moves[sign][0] + 0.5 if sign in moves else UNSEEN) / whole / n),
                             moves[sign][1] if sign in moves else s) for sign, n in SPREAD.items()}
            out[s][None] = (math.log2((self.ends[s] + 0.5) / whole), s)
        return out

    def _placed(self):
        """The same for states that know their place: a sign new to a state moves on like its commonest."""
        pool = Counter()
        for s in self.states:
            for sign, (n, _) in self.moves[s].items():
                pool[sign] += n
        signs, out = max(sum(pool.values()), 1), {}
        for s in self.states:
            moves = self.moves[s]
            onward = max(moves.items(), key=lambda m: (m[1][0], m[0]))[1][1] if moves else s
            rare = self.visits[s] < ENOUGH
            given = {sign: (moves[sign][0] if sign in moves else 0) + (
                SHARED * pool[sign] / signs if rare else 0) + FOREIGN for sign in SPREAD}
            end = self.ends[s] + 0.5 * rare
            whole = sum(given.values()) + end
            out[s] = {sign: (math.log2(given[sign] / whole / n) if moves else -math.inf,
                             moves[sign][1] if sign in moves else onward) for sign, n in SPREAD.items()}
            out[s][None] = (math.log2(end / whole) if end else -math.inf, s)
        return out

    def hope(self, plain: dict[str, float], least: float) -> dict[int, float]:
        """state -> the most that any continuation can still add to a score; infinite where a loop gains."""
        if least not in self._hope:
            best = {s: moves[None][0] for s, moves in self._log.items()}
            for gains in (False, True):     # what still grows after as many rounds as states grows for ever
                for _ in best:
                    grew = False
                    for s, moves in self._log.items():
                        top = max(moves[k][0] - plain[k] - least + best[moves[k][1]] for k in SPREAD)
                        if top > best[s] + 1e-9:
                            best[s], grew = math.inf if gains else top, True
                    if not grew:
                        break
            self._hope[least] = best
        return self._hope[least]

    def bits(self, text: str) -> float:
        """log2 likelihood; minus infinity for a text without the common beginning."""
        if not text.startswith(self.start):
            return -math.inf
        at, total = 0, 0.0
        for sign in map(CLASS_OF.__getitem__, text[len(self.start):]):
            more, at = self._log[at][sign]
            total += more
        return total + self._log[at][None][0]

    def ways(self, run: str, signs: list[str], value: list[float], begins: list[int], ends: list[int],
             hope: dict[int, float]):
        """(score, start, end) of the candidates of a run that score above 0.

        value: what each sign costs the other side. Of starts that meet in a state the
        best long enough one stays beside the later ones, as what follows is the same
        for all; and a start that no continuation can bring above 0 is left. So the work
        does not grow with the number of starts.
        """
        seen = self.seen
        skip, enter = len(self.start), {}
        if skip:
            begins, at = [], run.find(self.start)
            while at >= 0:
                begins.append(at)
                at = run.find(self.start, at + 1)
        for b in begins:
            inner = b and (signs[b - 1] in seen or signs[b - 1] not in MARKS)
            enter[b + skip] = (b, 0, -sum(value[b:b + skip]) - INNER_BITS * bool(inner))
        if not enter:
            return
        ends, live, trail = set(ends), [], len(run.rstrip(MARKS))
        for p, sign in enumerate(signs):
            if p in enter:
                live.append(enter[p])
            if not live:
                continue
            cost, log = value[p], self._log
            live = [way for b, s, x in live
                    if (way := (b, log[s][sign][1], x + log[s][sign][0] - cost))[2] + hope[way[1]] > 0]
            if len(live) > 1:
                best, young = {}, []
                for way in live:
                    if p + 1 - way[0] < SHORTEST:
                        young.append(way)
                    elif way[1] not in best or way[2] > best[way[1]][2]:
                        best[way[1]] = way
                live = [*best.values(), *young]
            if p + 1 in ends:
                after = signs[p + 1] if p + 1 < len(signs) else None
                inner = INNER_BITS * (after in seen and p + 1 < trail)
                for b, s, x in live:
                    x += log[s][None][0] - inner
                    if x > 0 and p + 1 - b >= SHORTEST:
                        yield x, b, p + 1


class Formats:
    """Automata of all labelled formats, beside those of ordinary and of harmless kinds and one of single signs."""

    def __init__(self, credentials: list[tuple[str, str]], ordinary: dict[str, list[str]] = ORDINARY,
                 harmless: list[tuple[str, str]] | None = None):
        by = defaultdict(list)
        for name, text in credentials:
            by[name].append(text)
        self.automata = {name: Automaton(words) for name, words in by.items()}
        by = defaultdict(list)
        for name, text in drawn(HARMLESS, PER_FORMAT, SEED) if harmless is None else harmless:
            by[name].append(text)
        self.ordinary = [Automaton(words, places=False) for words in ordinary.values()]
        self.ordinary += [Automaton(words) for words in by.values()]
        # words all in capitals and rules are kinds of their own: in with the others they would hide mixed tokens
        signs = Counter(CLASS_OF[c] for name, words in ordinary.items() if name not in APART
                        for word in words for c in word)
        whole = sum(signs.values()) + len(SPREAD)
        self.plain = {k: math.log2((signs[k] + 1) / whole / n) for k, n in SPREAD.items()}

    def beside(self, run: str, signs: list[str], least: float) -> list[float]:
        """What each sign must reach: its bits in the best ordinary kind for its part of the run, and `least`.

        Parts are letters and digits, or marks. A kind other than single signs costs its choice.
        """
        out, choice = [], math.log2(len(self.ordinary))
        for m in PART.finditer(run):
            plain = [self.plain[k] for k in signs[m.start():m.end()]]
            more = max(a.bits(m[0]) for a in self.ordinary) - choice - sum(plain)
            out += [x + least + max(more, 0) / len(plain) for x in plain]
        return out

    def spans(self, run: str, least: float = LEAST_BITS) -> list[tuple[int, int]]:
        """(start, end) of the credentials in a run of token signs: no overlap, highest sum, then leftmost."""
        signs = [CLASS_OF[c] for c in run]
        value = self.beside(run, signs, least)
        begins = [0] + [i for i in range(1, len(run)) if signs[i - 1] in MARKS]
        ends = [i for i in range(SHORTEST, len(run)) if signs[i] in MARKS] + [len(run)]
        found = {}
        for a in self.automata.values():
            for x, b, e in a.ways(run, signs, value, begins, ends, a.hope(self.plain, least)):
                found[b, e] = max(x, found.get((b, e), x))
        # best[i]: highest sum over the spans that end at or before the i-th end
        stops = sorted({e for _, e in found})
        by = defaultdict(list)
        for (b, e), x in found.items():
            by[e].append((b, x))
        best, took = [0.0], [None]
        for i, e in enumerate(stops):
            top, via = best[i], None
            for b, x in sorted(by[e]):
                before = bisect_right(stops, b)
                if best[before] + x > top:
                    top, via = best[before] + x, (b, before)
            best.append(top)
            took.append(via)
        out, i = [], len(stops)
        while i:
            if took[i] is None:
                i -= 1
            else:
                out.append((took[i][0], stops[i - 1]))
                i = took[i][1]
        return out[::-1]

    def gain(self, text: str) -> float:
        """Bits a sign by which the best format beats the best model of ordinary strings."""
        plain = max(sum(self.plain[CLASS_OF[c]] for c in text), *(a.bits(text) for a in self.ordinary))
        best = max((a.bits(text) for a in self.automata.values()), default=-math.inf)
        return (best - plain) / len(text)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed kinds, in order."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    return sorted(out)


def format_spans(text: str, formats: Formats, taken: list[tuple[int, int, int]],
                 least: float = LEAST_BITS) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what looks like a credential in what the taken spans leave of every run."""
    out, ahead, free = [], deque((s, e) for s, _, e in taken), 0
    for m in CANDIDATE.finditer(text):
        at, pieces = m.start(), []
        while ahead and ahead[0][0] < m.end():
            start, end = ahead.popleft()
            pieces.append((max(at, free), start))
            free = max(free, end)
        pieces.append((max(at, free), m.end()))
        for start, end in pieces:
            if end - start >= SHORTEST:
                out += [(start + b, 3, start + e) for b, e in formats.spans(text[start:end], least)]
    return out


def _told(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_secrets(docs: DataFrame, credentials: list[tuple[str, str]] | None = None,
                 least: float = LEAST_BITS) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_format, base_sha256, spans of every row.

    credentials: (format, text) rows to learn from; the labelled formats by default.
    """
    formats = Formats(labelled_credentials() if credentials is None else credentials)
    names = ["doc_id", "n_assign", "n_access", "n_hex", "n_format", "base_sha256", "spans"]

    @frugal
    def run(it):
        for batch in it:
            counts, hashed, spans = [[], [], [], []], [], []
            for text in batch.column("text"):
                text = text.as_py() or ""
                base = base_spans(text)
                more = format_spans(text, formats, base, least)
                for k, out in enumerate(counts):
                    out.append(sum(x[1] == k for x in base + more))
                hashed.append(hashlib.sha256(_told(base).encode()).hexdigest())
                spans.append(_told(sorted(base + more)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in counts],
                 pa.array(hashed, pa.string()), pa.array(spans, pa.string())], names=names)

    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_assign long, n_access long, n_hex long, n_format long, "
             "base_sha256 string, spans string")
