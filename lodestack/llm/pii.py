"""Personal data: checked patterns, and a semi-Markov conditional random field that adds spans they miss.

The field scores whole candidate spans by features of the span and of what stands beside it; dynamic programming over
spans of bounded length chooses boundaries and kinds together. A span needs a digit or an @, so texts are decoded in the
windows around such words only; elsewhere no span is possible. The field is trained by the forward-backward algorithm on
a bounded sample of windows whose labels are the pattern spans and quoted secrets, and on altered forms of these that no
pattern finds: secrets without a name before them, and short ones. So spans are added that no label came from.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import arrow_map, column, keyed, public_id, record_batch, texts

KINDS = ("email", "ip", "card", "phone", "secret")
#: Most tokens of a span.
MAX_TOKENS = 16
#: Bounds of what training reads: about so many documents, most windows in all, of one text and of one shape, and the most
#: characters of a window.
SAMPLE_DOCS, SAMPLE_WINDOWS, WINDOWS_PER_TEXT, WINDOWS_PER_SHAPE, WINDOW_CHARS = 40_000, 240, 8, 8, 200
#: Labelled spans that training also sees in altered forms.
ALTERED = 24
#: Log-odds by which a span must beat its tokens' being no data.
MARGIN = 1.0

# The patterns of the four base kinds.
# An address is found from its @ outwards, and an ip only where a run of digits begins, so long runs are read once.
EMAIL_LOCAL, EMAIL_HOST = re.compile(r"[A-Za-z0-9._%+-]+"), re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_DIGIT = re.compile(r"[0-9]")
_MARKED = re.compile(r"[0-9@]\S*")
_TOKEN = re.compile(r"[A-Za-z0-9]+|.", re.S)
_SECRET = re.compile(r"(?i)\b(?:token|secret|api_?key|password)\s*[=:]\s*[\"']?([0-9A-Za-z_-]{24,})")
_NAMED = re.compile(r"(?i)(?:token|secret|key|password)\s*[=:]\s*[\"']?$")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _number(s: str) -> bool:
    return s.isascii() and s.isdigit()


def _emails(text: str) -> list[tuple[int, int, str]]:
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        local = EMAIL_LOCAL.match(text[free:at][::-1])
        host = EMAIL_HOST.match(text, at + 1) if local else None
        if host:
            found.append((at - local.end(), host.end(), "email"))
        free = host.end() if host else at + 1
        at = text.find("@", free)
    return found


def windows(text: str) -> list[tuple[int, int]]:
    """Runs of words with a digit or an @, each one space from the next. Linear in the text."""
    found, last = [], 0
    for m in _MARKED.finditer(text):
        lo, hi = m.span()
        before = text[last:lo]
        if before and not before[-1].isspace():
            lo -= len(before.rsplit(None, 1)[-1])
        if found and lo == last + 1 and text[last] == " ":
            found[-1] = found[-1][0], hi
        else:
            found.append((lo, hi))
        last = hi
    return found


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the base kinds, by start and then kind."""
    found = []
    if "@" in text:
        found += _emails(text)
    if _DIGIT.search(text):
        found += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(len(x) < 4 and int(x or "0") <= 255 for x in (p.lstrip("0") for p in m.group().split(".")))]
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), "card"))
        if "+" in text:
            found += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m.group())) <= 15]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


FEATURES = 25


def features(text: str, lo: int, hi: int) -> np.ndarray:
    """Features of the candidate span text[lo:hi] with its surroundings."""
    s = text[lo:hi]
    digits = "".join(_DIGIT.findall(s))
    n, before, after = len(digits), text[lo - 1 : lo], text[hi : hi + 1]
    parts, bare = s.split("."), s.replace(" ", "").replace("-", "")
    at = s.count("@")
    f = (
        1,
        at == 1 and 0 < s.index("@") and "." in s[s.index("@") :] and s[-1] != ".",
        at > 0,
        len(parts) == 4 and all(len(p) < 4 and _number(p) and int(p) < 256 for p in parts),
        "." in s,
        12 <= n <= 19 and bare.isdigit(),
        12 <= n <= 19 and bare.isdigit() and luhn(digits),
        9 <= n <= 15,
        s[0] == "+",
        s[0] == "+" and 9 <= n <= 15,
        "(" in s and ")" in s,
        n < 7,
        n == len(s) and n > 15,
        len(s) >= 24 and s.isalnum() and n < len(s),
        len(s) >= 16 and s.isalnum() and 2 <= n <= len(s) - 2,
        any(c.isalpha() for c in s),
        " " in s,
        bool(_NAMED.search(text[max(0, lo - 16) : lo])),
        before in ('"', "'") and after in ('"', "'") and before != "",
        before.isalnum() or before in ("+", "@", "-", "%", "_"),
        after.isalnum() or after in ("@", "_"),
        before in (".", "(", ")") and n > 0,
        after in (".", "-") and text[hi + 1 : hi + 2].isalnum(),
        before == " " and _number(text[lo - 2 : lo - 1]),
        after == " " and _number(text[hi + 1 : hi + 2]),
    )
    return np.array(f, np.float64)


def candidates(text: str, lo: int, hi: int) -> tuple[list[int], list[tuple[int, int]], np.ndarray]:
    """Token bounds of a window, its candidate spans as token indices, and their features."""
    cuts = [lo, *(m.end() for m in _TOKEN.finditer(text, lo, hi))]
    open_ = [text[c].isascii() and (text[c].isalnum() or text[c] in "+(") for c in cuts[:-1]]
    shut = [text[c - 1].isascii() and text[c - 1].isalnum() for c in cuts[1:]]
    marked = np.concatenate(([0], np.cumsum([bool(re.search("[0-9@]", text[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)])))
    spans = [(i, j) for i in range(len(open_)) if open_[i] for j in range(i + 1, min(i + MAX_TOKENS, len(open_)) + 1) if shut[j - 1] and marked[j] > marked[i]]
    x = np.array([features(text, cuts[i], cuts[j]) for i, j in spans]) if spans else np.empty((0, FEATURES))
    return cuts, spans, x


def _lse(values: np.ndarray) -> float:
    top = values.max()
    return top + np.log(np.exp(values - top).sum())


def _gradient(n: int, spans, x, gold, w) -> np.ndarray:
    """Gradient of the log-likelihood of one window: gold features less expected ones."""
    score = x @ w.T
    ending, starting = [[] for _ in range(n + 1)], [[] for _ in range(n + 1)]
    for k, (i, j) in enumerate(spans):
        ending[j].append(k)
        starting[i].append(k)
    a, b = np.zeros(n + 1), np.zeros(n + 1)
    for j in range(1, n + 1):
        a[j] = _lse(np.concatenate(([a[j - 1]], *((a[spans[k][0]] + score[k]) for k in ending[j]))))
    for i in range(n - 1, -1, -1):
        b[i] = _lse(np.concatenate(([b[i + 1]], *((b[spans[k][1]] + score[k]) for k in starting[i]))))
    at = np.array(spans).reshape(-1, 2)
    p = np.exp(a[at[:, 0], None] + score + b[at[:, 1], None] - a[n])
    return (gold - p).T @ x


def train(windows: list[tuple[str, int, int, list[tuple[int, int, str]]]], rounds: int = 60, decay: float = 0.01) -> np.ndarray:
    """Weights (kinds x features) that maximise the likelihood of labelled windows (text, from, to, spans)."""
    data = []
    for text, lo, hi, gold in windows:
        cuts, spans, x = candidates(text, lo, hi)
        if spans:
            y = np.zeros((len(spans), len(KINDS)))
            for k, (i, j) in enumerate(spans):
                for a, b, kind in gold:
                    if (cuts[i], cuts[j]) == (a, b):
                        y[k, KINDS.index(kind)] = 1
                        break
            data.append((len(cuts) - 1, spans, x, y))
    w, seen = np.zeros((len(KINDS), FEATURES)), np.full((len(KINDS), FEATURES), 1e-6)
    w[:, 0] = -2
    for _ in range(rounds):
        g = sum((_gradient(*d, w) for d in data), np.zeros_like(w)) / max(1, len(data)) - decay * w
        seen += g * g
        w += 0.8 * g / np.sqrt(seen)
    return w


def decode(text: str, lo: int, hi: int, w: np.ndarray) -> list[tuple[int, int, str]]:
    """The spans of the best segmentation of a window."""
    cuts, spans, x = candidates(text, lo, hi)
    if not spans:
        return []
    score = x @ w.T - MARGIN
    kind, value = score.argmax(axis=1), score.max(axis=1)
    n = len(cuts) - 1
    best, back, ending = np.zeros(n + 1), [None] * (n + 1), [[] for _ in range(n + 1)]
    for k, (_, j) in enumerate(spans):
        ending[j].append(k)
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for k in ending[j]:
            if (v := best[spans[k][0]] + value[k]) > best[j]:
                best[j], back[j] = v, k
    out, j = [], n
    while j:
        if back[j] is None:
            j -= 1
        else:
            i = spans[back[j]][0]
            out.append((cuts[i], cuts[j], KINDS[kind[back[j]]]))
            j = i
    return out[::-1]


def all_spans(text: str, w: np.ndarray | None, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Base spans, and those of the field that touch none of them."""
    spans = list(base)
    if w is not None:
        taken: list[list[int]] = []  # the union of base spans, in order
        for lo, hi, _ in base:
            if taken and lo < taken[-1][1]:
                taken[-1][1] = max(hi, taken[-1][1])
            else:
                taken.append([lo, hi])
        k = 0
        for lo, hi in windows(text):
            for s in decode(text, lo, hi, w):
                while k < len(taken) and taken[k][1] <= s[0]:
                    k += 1
                if k == len(taken) or s[1] <= taken[k][0]:
                    spans.append(s)
    return sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


_SAMPLE = pa.schema([("around", pa.string()), ("lo", pa.int32()), ("hi", pa.int32()), ("spans", pa.string())])
_FOUND = pa.schema([("_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS[:4]), ("n_added", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("redacted", pa.string())])


def _windows(batches):
    """Windows of texts with their labels and surroundings."""
    for batch in batches:
        out = []
        for raw in texts(batch):
            text = raw.decode("utf-8", "replace")
            some = sorted((w for w in windows(text) if w[1] - w[0] < WINDOW_CHARS), key=lambda w: xxhash.xxh3_64_intdigest(text[w[0] : w[1]]))[:WINDOWS_PER_TEXT]
            gold = [*base_spans(text), *((m.start(1), m.end(1), "secret") for m in _SECRET.finditer(text))] if some else []
            for lo, hi in some:
                a = max(0, lo - 20)
                mine = [(x - a, y - a, k) for x, y, k in gold if lo <= x and y <= hi]
                out.append((text[a : hi + 4], lo - a, hi - a, ";".join(f"{x},{y},{k}" for x, y, k in mine)))
        yield record_batch(_SAMPLE, *zip(*out, strict=True)) if out else record_batch(_SAMPLE, *[[]] * 4)


def _altered(around: str, lo: int, hi: int, gold: list[tuple[int, int, str]]) -> list[tuple[str, int, int, list]]:
    """Windows with one span that is data still, but in a form that no pattern finds."""
    if len(gold) != 1:
        return []
    (a, b, kind), out = gold[0], []
    if kind == "secret":
        if named := re.search(r"\S*\s*[=:]\s*[\"']?$", around[:a]):  # without its name and quotes
            cut = a - named.start()
            tail = around[b:].lstrip("\"'")
            out.append((around[: named.start()] + around[a:b] + tail, named.start(), b - cut, [(named.start(), b - cut, kind)]))
        size = 16 + sum(map(ord, around[a:b])) % 8
        short = around[a : a + size]
        if 2 <= len(_DIGIT.findall(short)) <= size - 2 and size < b - a:
            out.append((around[: a + size] + around[b:], lo, hi - (b - a) + size, [(a, a + size, kind)]))
    return out


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_windows: int = SAMPLE_WINDOWS) -> np.ndarray | None:
    """Weights fitted on at most sample_windows windows of about sample_docs documents, chosen by hashes of id and text.

    docs: (_id, _text). Of a text at most WINDOWS_PER_TEXT windows are read, of windows of one shape (letters and digits
    alike) at most WINDOWS_PER_SHAPE, and none of WINDOW_CHARS characters or more. None if no window has a labelled span.
    These bounds concern training alone; spans are sought in whole texts.
    """
    share = (1 << 30) * sample_docs // max(1, docs.count())
    some = docs.where(F.pmod(F.xxhash64("_id", "_text"), F.lit(1 << 30)) < share)
    rows = arrow_map(some, _windows, "around string, lo int, hi int, spans string").distinct()
    rows = rows.orderBy(F.xxhash64("around", "lo"), "around", "lo").limit(sample_windows * 20).collect()
    kept, shapes = [], {}
    for r in rows:
        gold = [(int(a), int(b), k) for a, b, k in (x.split(",") for x in r["spans"].split(";") if x)]
        shape = re.sub("[a-z]+", "a", re.sub("[0-9]", "9", r["around"][r["lo"] : r["hi"]])), tuple(k for _, _, k in gold)
        shapes[shape] = shapes.get(shape, 0) + 1
        if shapes[shape] <= WINDOWS_PER_SHAPE and len(kept) < sample_windows:
            kept.append((r["around"], r["lo"], r["hi"], gold))
    forms = [more for w in kept if (more := _altered(*w))]
    kept += [w for more in forms[:ALTERED] for w in more]
    return train(kept) if any(g for *_, g in kept) else None


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with every span replaced by its kind; of spans that overlap, the union by the first one's kind."""
    out, last = [], 0
    for lo, hi, kind in spans:
        if lo >= last:
            out += [text[last:lo], f"<{kind.upper()}>"]
        last = max(last, hi)
    return "".join((*out, text[last:]))


def _found(w: np.ndarray | None, redacted: bool):
    joined = lambda spans: ",".join(f"{k}:{a}:{b}" for a, b, k in spans)

    def run(batches):
        for batch in batches:
            out = []
            for i, raw in zip(column(batch, "_id"), texts(batch), strict=True):
                text = raw.decode("utf-8", "replace")
                base = base_spans(text)
                spans = all_spans(text, w, base)
                n = [*(sum(1 for s in base if s[2] == k) for k in KINDS[:4]), len(spans) - len(base)]
                out.append((i, *n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), redact(text, spans) if redacted else None))
            yield record_batch(_FOUND, *zip(*out, strict=True)) if out else record_batch(_FOUND, *[[]] * len(_FOUND))

    return run


def find_personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: np.ndarray | None = None, redacted: bool = True) -> DataFrame:
    """One row per document: id, n_email, n_ip, n_card, n_phone, n_added, base_sha256, spans, redacted.

    spans is kind:start:end in code points, comma-joined; the counts by kind are of base spans. A null or empty text has none.
    Without weights the field is fitted on df; if that has no labelled window, base spans are all. Repeated rows give equal
    rows; null ids stay. Other columns are ignored.
    """
    docs = keyed(df, id_col, text_col)
    w = fit(docs) if weights is None else weights
    ddl = "_id long, n_email long, n_ip long, n_card long, n_phone long, n_added long, base_sha256 string, spans string, redacted string"
    done = arrow_map(docs, _found(w, redacted), ddl)
    return done.select(public_id().alias(id_col), *done.columns[1:])


def _redacted(at: int, length_at: int | None, w: np.ndarray | None):
    def run(batches):
        for batch in batches:
            columns = list(batch.columns)
            old = columns[at].to_pylist()
            text = [None if t is None else redact(t, all_spans(t, w, base_spans(t))) for t in old]
            columns[at] = pa.array(text, columns[at].type)
            if length_at is not None:
                now = [n if a == b else len(b) for n, a, b in zip(columns[length_at].to_pylist(), old, text, strict=True)]
                columns[length_at] = pa.array(now, columns[length_at].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return run


def redact_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The rows of df with personal data replaced by <KIND>; length_col is brought up to date where a text changed.

    Null texts stay null, empty ones empty. Repeated rows stay and are treated alike, null ids too; other columns pass
    through. An empty table gives an empty one.
    """
    w = fit(keyed(df, id_col, text_col))
    length = df.columns.index(length_col) if length_col in df.columns else None
    return arrow_map(df, _redacted(df.columns.index(text_col), length, w), df.schema)
