"""Personal data by weak supervision.

Four base patterns give spans that always stay. Wide patterns give candidates, most of which need not be personal data:
any word before a domain after "at", groups of digits, long words with digits and values after a key, pairs of capitalised
words. Four labelers, each of which looks at something else, vote yes or no on a candidate or abstain: its letters and
digits, lists of known names and formats, the words before it, and what touches it. Expectation-maximisation over vote
patterns estimates how reliable the labelers are for each kind; its posteriors train a logistic span classifier, which
decides on the candidates.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few, table, texts, tidy, written

# The kinds, in the order that ties follow.
KINDS = ("email", "ip", "card", "phone", "secret", "person", "ssn", "iban")
BASE = KINDS[:4]
ORDER = {k: i for i, k in enumerate(KINDS)}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9][0-9.]*")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

# What follows the local part of a spelled-out address.
_AT = re.compile(r"(?: ?[\[(] ?[Aa][Tt] ?[\])] ?| at )[A-Za-z0-9-]{1,63}(?:(?: ?[\[(] ?[Dd][Oo][Tt] ?[\])] ?| dot |\.)[A-Za-z0-9-]{1,63}){1,4}")
# Candidates beyond the base: kind, a literal that must be there, the pattern, the group that is the span.
_WIDE = (
    ("secret", "=", re.compile(r"\b([A-Za-z_-]{2,24}) ?= ?[\"']?([^\s\"'=]{6,}+)[\"']?"), 2),
    ("secret", ":", re.compile(r"\b([A-Za-z_-]{2,24}) ?: ?[\"']?([^\s\"':]{6,}+)[\"']?"), 2),
)
_WIDE_DIGITS = (
    ("secret", re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+"), 0),
    ("ssn", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"), 0),
    ("iban", re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"), 0),
    ("phone", re.compile(r"(?<![0-9+.-])(?:\([0-9]{2,5}\) ?|[0-9]{2,5}[ .-])[0-9]{2,5}(?:[ .-][0-9]{2,5}){1,3}(?![0-9-])"), 0),
)
_PAIR = re.compile(r"\b[A-Z][^\W\d_]{1,30} [A-Z](?:[^\W\d_]|['-](?=[^\W\d_]))++")
_TITLED = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof)\. ([A-Z][a-z]{1,30})(?! [A-Z][a-z])")

# Gazetteers and context words.
TOP_DOMAINS = frozenset("com org net edu gov io co info biz uk de fr es it nl eu us ca au jp cn in br ru ch se no pl".split())
SECRET_KEYS = frozenset("password passwd pwd pass token secret apikey api-key key access-key auth credential credentials bearer".split())
OTHER_KEYS = frozenset("id sha sha1 sha256 md5 commit revision version build date time isbn doi page model part sku order ref file path hash digest etag".split())
SECRET_STARTS = ("ghp_", "gho_", "sk-", "AKIA", "xoxb-", "xoxp-", "eyJ", "AIza")
FIRST_NAMES = frozenset("James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Maria Anna Peter Paul Hans Pierre Juan Carlos".split())
NOT_NAMES = frozenset("The This That New Old Great Saint North South East West Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April May June July August September October November December United Los San Las".split())
NOT_SURNAMES = frozenset("Street Road Avenue Square Park River Lake University College School Institute Inc Ltd Corp Company City County Times Post Bank House Hall".split())
PLAIN_WORDS = frozenset("look is was are be meet arrive stay live work call stand at it here us me them him her available located hosted found".split())
COUNTRIES = frozenset("AT BE CH CZ DE DK ES FI FR GB GR HU IE IT LU NL NO PL PT RO SE".split())
TITLES = frozenset("mr mrs ms dr prof".split())
CONTEXT = {
    "email": frozenset("email e-mail mail contact write reach".split()),
    "ip": frozenset("ip address host server from".split()),
    "card": frozenset("card visa mastercard credit payment".split()),
    "phone": frozenset("phone tel telephone call mobile fax cell".split()),
    "secret": SECRET_KEYS | {"login", "credentials"},
    "person": frozenset("name contact by from dear regards signed author met told asked".split()) | TITLES,
    "ssn": frozenset("ssn social security".split()),
    "iban": frozenset("iban account bank transfer".split()),
}
#: Words before a candidate that speak against its kind.
AGAINST = {
    "phone": frozenset("isbn order invoice version page pages item part no room total between score year years".split()),
    "secret": OTHER_KEYS,
    "person": frozenset("in at the near to visit via street city".split()),
    "ssn": frozenset("order part item invoice no sku serial".split()),
    "iban": frozenset("order part item serial model".split()),
}
_WORD = re.compile(r"[A-Za-z][A-Za-z0-9-]*")
_DATE = re.compile(r"(?:19|20)[0-9]{2}[ .-][01]?[0-9][ .-][0-3]?[0-9]|[0-3]?[0-9][ .-][01]?[0-9][ .-](?:19|20)[0-9]{2}")
_FILE = re.compile(r"\.[A-Za-z]{1,4}$|^[a-z]+(?:[-_/][a-z0-9]+)+$")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the base patterns: leftmost, non-overlapping per kind, failing matches dropped. In linear time."""
    found: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            found.append((start, m.end(), "email"))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    if first := _DIGIT.search(text):
        for run in _DOTTED.finditer(text, first.start()):
            if run.group().count(".") >= 3:
                found += [(m.start(), m.end(), "ip") for m in _IP.finditer(text, run.start(), run.end()) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(text, first.start()):
            if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m.group())) <= 19 and luhn(d):
                found.append((m.start(), m.end(), "card"))
        if "+" in text:
            found += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 10 <= len(_digits(m.group())) <= 15]
    found.sort(key=lambda s: (s[0], ORDER[s[2]]))
    return found


def candidates(text: str, base: list[Span]) -> list[Span]:
    """Wider candidates that overlap no base span, leftmost first; of overlapping ones the earlier, then the longer."""
    wide: list[Span] = []
    if "(" in text or "[" in text or " at " in text:
        free = 0
        for m in _AT.finditer(text):  # the local part is the whole run before
            start = m.start()
            while start > free and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                wide.append((start, m.end(), "email"))
                free = m.end()
    for kind, literal, pattern, group in _WIDE:
        if literal in text:
            wide += [(m.start(group), m.end(group), kind) for m in pattern.finditer(text)]
    if _DIGIT.search(text):
        for kind, pattern, group in _WIDE_DIGITS:
            wide += [(m.start(group), m.end(group), kind) for m in pattern.finditer(text) if kind != "phone" or 7 <= len(_digits(m.group())) <= 15]
    if " " in text:
        wide += [(m.start(), m.end(), "person") for m in _PAIR.finditer(text)]
    if ". " in text:
        wide += [(m.start(1), m.end(1), "person") for m in _TITLED.finditer(text)]
    if not wide:
        return []
    out, free, k = [], 0, 0
    base = sorted(base)
    for s, e, kind in sorted(wide, key=lambda x: (x[0], -x[1], x[2] == "phone", ORDER[x[2]])):
        while k < len(base) and base[k][1] <= s:  # ends of base spans rise but for those inside others
            k += 1
        if s >= free and not any(s < b and a < e for a, b, _ in base[max(0, k - 4) : k + 4]):
            out.append((s, e, kind))
            free = e
    return out


def votes(text: str, span: Span) -> tuple[int, int, int, int]:
    """What the labelers of letters and digits, of lists, of the words before and of what touches a span say: 1 yes, 0 no, 2 abstains."""
    s, e, kind = span
    value, before = text[s:e], text[max(0, s - 64) : s]
    return _shape(kind, value), _listed(kind, value), _context(kind, before), _touching(kind, value, text[max(0, s - 2) : s], text[e : e + 12])


def _shape(kind: str, value: str) -> int:
    digits = _digits(value)
    if kind == "email":
        return int("@" in value or "(" in value or "[" in value)
    if kind == "ip":
        return int(value.count(".") == 3)
    if kind == "card":
        return int(luhn(digits))
    if kind == "phone":
        return 0 if _DATE.fullmatch(value) or not 9 <= len(digits) <= 13 else 1 if value[0] in "+(" or len(digits) == 10 and len(digits) == len(value) - 2 else 2
    if kind == "secret":
        mixed = any(c.isalpha() for c in value) and bool(digits)
        return int(mixed and len(value) >= 12 and len(set(value)) >= 8)
    if kind == "person":
        return int(all(2 <= len(w) <= 20 and (w[1:].islower() or not w.isalpha()) for w in value.split()))
    if kind == "ssn":
        return int(value[:3] not in ("000", "666") and value[0] != "9" and value[4:6] != "00" and value[7:] != "0000")
    compact = value.replace(" ", "")
    return int(int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1)


def _listed(kind: str, value: str) -> int:
    digits = _digits(value)
    if kind == "email":
        return int(re.split(r"[^A-Za-z]+", value.rstrip(")] "))[-1].lower() in TOP_DOMAINS)
    if kind == "ip":
        return 2 if value.startswith("0.") else 1
    if kind == "card":
        return int(digits[0] in "3456")
    if kind == "phone":
        return 2 if len(digits) != 10 else int(digits[0] not in "01")
    if kind == "secret":
        body = value.strip("\"'.,;")
        if body.startswith(SECRET_STARTS):
            return 1
        return 0 if _FILE.search(body) or body.isalpha() or body.isdigit() else 2
    if kind == "person":
        first, *rest = value.split()
        return 0 if first in NOT_NAMES or rest and rest[-1] in NOT_SURNAMES else int(first in FIRST_NAMES) if rest else 2
    if kind == "ssn":
        return 2
    return int(value[:2] in COUNTRIES)


def _context(kind: str, before: str) -> int:
    words = [w.lower() for w in _WORD.findall(before.replace("_", "-"))]
    last = set(words[-1:] if kind in ("secret", "person") else words[-2:])
    if last & AGAINST.get(kind, frozenset()):
        return 0
    return 1 if CONTEXT[kind].intersection(words[-3:] if kind == "person" else words[-6:]) else 0 if kind == "person" else 2


def _touching(kind: str, value: str, left: str, right: str) -> int:
    if left[-1:].isalnum() or right[:1].isalnum() and kind != "person":
        return 0
    if kind == "email":
        local = re.split(r"[ \[(]", value)[0]
        return 0 if local.lower() in PLAIN_WORDS else 1 if any(c in "._+-0123456789" for c in local) else 2
    if kind == "secret":
        return 0 if left[-1:] in ("/", "#", "@") or right[:1] in ("/", "(") else 1 if left[-1:] in ('"', "'") and right[:1] == left[-1:] else 2
    if kind == "person":
        return 0 if re.match(r" (?:[A-Z]|Inc|Ltd|Corp)", right) else 1 if right[:2] == "'s" or re.match(r",? (?:said|wrote|told|asked|signed|born|aged)", right) else 2
    if kind in ("phone", "ssn", "iban"):
        return 0 if left[-1:] in ("$", "#", "/", "€", "£") or right[:1] in ("%", "/") else 2
    return 1


def pattern(text: str, span: Span, is_base: bool) -> tuple[int, ...]:
    """Kind, votes, a length class and whether a base pattern gave the span: all that the model sees of it."""
    n = span[1] - span[0]
    return ORDER[span[2]], *votes(text, span), 0 if n < 12 else 1 if n < 24 else 2, int(is_base)


class SpanModel:
    """Labeler reliabilities and the span classifier's weights; its size is fixed by the numbers of kinds and labelers."""

    def __init__(self, counts: dict[tuple[int, ...], int], rounds: int = 40) -> None:
        """counts: spans by pattern. A pattern's posterior starts from its vote share and is refined by EM, by kind."""
        keys = sorted(counts)
        self.reliability = np.full((len(KINDS), 4, 2), 0.8)
        self.weights: dict[str, np.ndarray] | None = None
        if not keys:
            self.weight = np.zeros(self._features([(0, 2, 2, 2, 2, 0, 0)]).shape[1])
            return
        k, n = np.array(keys), np.array([counts[x] for x in keys], float)
        v = k[:, 1:5]
        yes, no = v == 1, v == 0
        post = np.where(k[:, 6] == 1, 0.95, (yes.sum(1) + 0.5) / (yes.sum(1) + no.sum(1) + 1.0))
        for _ in range(rounds):
            fresh = post.copy()
            for kind in np.unique(k[:, 0]):
                of = k[:, 0] == kind
                w1, w0 = n[of] * post[of], n[of] * (1 - post[of])
                prior = (w1.sum() + 1) / (n[of].sum() + 2)
                # say yes given a true span, say no given a false one; priors keep a labeler that never errs from certainty
                hit = ((yes[of] * w1[:, None]).sum(0) + 8) / (((yes | no)[of] * w1[:, None]).sum(0) + 10)
                reject = ((no[of] * w0[:, None]).sum(0) + 8) / (((yes | no)[of] * w0[:, None]).sum(0) + 10)
                self.reliability[kind] = np.stack([hit, reject], 1)
                l1 = np.log(prior) + (yes[of] * np.log(hit) + no[of] * np.log(1 - hit)).sum(1)
                l0 = np.log(1 - prior) + (yes[of] * np.log(1 - reject) + no[of] * np.log(reject)).sum(1)
                fresh[of] = np.where(k[of, 6] == 1, 0.95, 1 / (1 + np.exp(np.clip(l0 - l1, -30, 30))))
            if np.abs(fresh - post).max() < 1e-6:
                break
            post = fresh
        x = self._features(keys)
        w = np.zeros(x.shape[1])
        scale = n / n.sum()
        for _ in range(25):  # Newton steps of ridge logistic regression on soft labels
            p = 1 / (1 + np.exp(-x @ w))
            grad = x.T @ (scale * (p - post)) + 1e-4 * w
            hess = (x * (scale * p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-4 * np.eye(len(w))
            w -= np.clip(np.linalg.solve(hess, grad), -5, 5)
        self.weight = w

    @staticmethod
    def _features(keys) -> np.ndarray:
        k = np.array(keys)
        parts = [np.ones((len(k), 1)), np.eye(len(KINDS))[k[:, 0]], np.eye(3)[k[:, 5]]]
        parts += [np.eye(3)[k[:, i]] for i in range(1, 5)]
        return np.hstack(parts)

    def accepts(self, keys: list[tuple[int, ...]]) -> np.ndarray:
        return self._features(keys) @ self.weight >= 0


def spans_text(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


@tidy
def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter = Counter()
    for b in batches:
        for t in texts(b, 0):
            base = base_spans(t)
            total.update(pattern(t, s, True) for s in base)
            total.update(pattern(t, s, False) for s in candidates(t, base))
    yield pa.RecordBatch.from_pydict({"pattern": pa.array([list(k) for k in total], pa.list_(pa.int32())), "n": pa.array(list(total.values()), pa.int64())})


def _collect(counts: DataFrame) -> SpanModel:
    """The patterns' counts come to the driver: at most kinds x 81 votes x 6 rows, whatever the input."""
    rows = counts.groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    return SpanModel({tuple(r["pattern"]): r["n"] for r in rows})


def fit(docs: DataFrame, text_col: str = "text") -> SpanModel:
    """A model from all texts."""
    return _collect(docs.select(F.col(f"`{text_col}`").alias("t")).mapInArrow(_counts, "pattern array<int>, n long"))


def spans_of(text: str, model: SpanModel) -> list[Span]:
    """Base spans and accepted candidates, by start and kind."""
    base = base_spans(text)
    more = candidates(text, base)
    if more:
        yes = model.accepts([pattern(text, s, False) for s in more])
        base = sorted(base + [s for s, ok in zip(more, yes, strict=True) if ok], key=lambda s: (s[0], ORDER[s[2]]))
    return base


def mask(docs: DataFrame, model: SpanModel, text_col: str = "text") -> DataFrame:
    """docs with each span of its texts replaced by its kind in square brackets; null texts stay null, all columns stay."""
    schema = docs.schema
    place = docs.columns.index(text_col)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few(batches):
            out = []
            for t in b.column(place).to_pylist():
                spans = spans_of(t, model) if t else []
                parts, at = [], 0
                for s, e, k in spans:
                    if e <= at:
                        continue
                    parts += [t[at:max(s, at)], f"[{k.upper()}]" if s >= at else ""]
                    at = e
                out.append(t if not spans else "".join(parts) + t[at:])
            columns = list(b.columns)
            columns[place] = pa.array(out, columns[place].type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return docs.mapInArrow(run, schema)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: id, counts of base spans by kind, base_sha256 and spans (kind:start:end, in code points).

    Null and empty texts have no spans; repeated rows and ids are treated row by row; an empty table gives an empty
    table; other columns are ignored. Texts are read once: spans and patterns go to a written table without texts.
    """
    kinds = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {x: [] for x in ("base", "more", "patterns", "base_patterns")}
            for t in texts(b, 1):
                base = base_spans(t)
                more = candidates(t, base)
                out["base"].append(spans_text(base))
                out["more"].append(spans_text(more))
                out["patterns"].append([list(pattern(t, s, False)) for s in more])
                out["base_patterns"].append([list(pattern(t, s, True)) for s in base])
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "base": pa.array(out["base"], pa.string()), "more": pa.array(out["more"], pa.string()), "patterns": pa.array(out["patterns"], pa.list_(kinds)), "base_patterns": pa.array(out["base_patterns"], pa.list_(kinds))})

    ids = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    found = written(found.mapInArrow(run, f"doc_id {ids}, base string, more string, patterns array<array<int>>, base_patterns array<array<int>>"), "pii")
    each = found.select(F.explode(F.concat("patterns", "base_patterns")).alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n"))
    model = _collect(each)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, spans = b.column(1).to_pylist(), []
            for known, more, patterns in zip(base, b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if more:
                    yes = model.accepts([tuple(p) for p in patterns])
                    chosen = known.split(",") * bool(known) + [s for s, ok in zip(more.split(","), yes, strict=True) if ok]
                    known = ",".join(sorted(chosen, key=lambda s: (int(s.split(":")[1]), ORDER[s.split(":")[0]])))
                spans.append(known)
            n = {k: pa.array([sum(s.startswith(k) for s in x.split(",")) for x in base], pa.int64()) for k in BASE}
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0)} | {f"n_{k}": v for k, v in n.items()} | {"base_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in base], pa.string()), "spans": pa.array(spans, pa.string())})

    return found.select("doc_id", "base", "more", "patterns").mapInArrow(decide, f"doc_id {ids}, {', '.join(f'n_{k} long' for k in BASE)}, base_sha256 string, spans string")


def op2_weak_supervision_pii(spark, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))
