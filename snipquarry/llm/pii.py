"""Personal data: fixed patterns, and further spans that a character tagger learned from them."""

import heapq
import random
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from snipquarry.llm.common import per_batch, sliced, strings
from snipquarry.llm.tagger import PAD, Tagger, encoded
from snipquarry.plans.scratch import written

KINDS = ["email", "ip", "card", "phone"]

# The patterns of the base kinds and their least and most digits.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CARD_DIGITS, PHONE_DIGITS, MOST_PART = (12, 19), (9, 15), 255

# The tagger reads windows of this many characters; each begins STRIDE after the one before it.
WINDOW, STRIDE = 96, 48
# A window is read where it holds a mark that every known form has: a digit, "@", or "at" before a name with a dot in any form.
MARK = re.compile(r"[0-9]+|@")
AT = re.compile(r"(?i)\bat\b\s?[\])}]?\s{0,3}[a-z0-9-]{1,63}(?:\.[a-z]|\s\.\s|\s{0,3}[\[({]\s{0,3}\.|\s{0,3}[\[({]?\s{0,3}dot\b)")
# What a span may begin and end with: words, and the signs before and within them.
WORD = re.compile(r"[(+]*\w(?:\S*\w)?")
# Labelled windows to learn from, for each kind and for windows without any.
SAMPLE = 200
LEARNED = 64
SURE = 0.5
BLOCK = 256


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= MOST_PART


def _within(n: int, bounds) -> bool:
    return bounds[0] <= n <= bounds[1]


def _emails(text: str):
    """Matches of a local part, "@" and a domain: one step from each "@" to both sides."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the fixed patterns, by start and then by kind.  Linear in the text."""
    found = [(a, b, 0) for a, b in _emails(text)]
    if MARK.search(text) is None:
        return found
    found += [(m.start(), m.end(), 1) for m in IP.finditer(text) if all(map(_small, m.group().split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= CARD_DIGITS[0]:
            digits = _digits(m.group())
            if _within(len(digits), CARD_DIGITS) and luhn(digits):
                found.append((m.start(), m.end(), 2))
    if "+" in text:
        found += [(m.start(), m.end(), 3) for m in PHONE.finditer(text) if _within(len(_digits(m.group())), PHONE_DIGITS)]
    return sorted(found, key=lambda s: (s[0], s[2]))


# --- other ways to write the same

_OPEN, _CLOSE = r"[\[({]\s?", r"\s?[\])}]"
_AT = re.compile(rf"(?i)\s?{_OPEN}(?:at|@){_CLOSE}\s?|\s+at\s+|\s?@\s?")
_DOT = re.compile(rf"(?i)\s?{_OPEN}(?:dot|\.){_CLOSE}\s?|\s+dot\s+|\s\.\s|\.")


def holds(kind: int, text: str) -> bool:
    """Whether a text, in any of the forms that are known, is of a kind: the exact check of what the tagger finds."""
    if kind == 0:
        plain = _DOT.sub(".", _AT.sub("@", text))
        spans = list(_emails(plain))
        return spans == [(0, len(plain))] and plain.rsplit(".", 1)[1].isalpha() and len(plain.rsplit(".", 1)[1]) > 1
    if kind == 1:
        plain = _DOT.sub(".", text)
        return bool(re.fullmatch(r"[0-9]+(?:\.[0-9]+){3}", plain)) and all(map(_small, plain.split(".")))
    digits = _digits(text)
    if kind == 2:
        groups = re.fullmatch(r"[0-9]+(?:[\s./_-]{1,3}[0-9]+)*", text)
        return bool(groups) and _within(len(digits), CARD_DIGITS) and luhn(digits)
    # A number without "+" must be grouped as phone numbers are.
    grouped = re.fullmatch(r"(?:\+|00)?[\s.-]?(?:[0-9]{1,3}[\s./-]{1,2})?(?:\([0-9]{2,5}\)|[0-9]{2,5})[\s./-]{1,2}[0-9]{3,4}(?:[\s./-]{1,2}[0-9]{2,4}){0,3}", text)
    # A "00" stands for the "+" and may be no part of the number.
    return bool(grouped) and any(_within(n, PHONE_DIGITS) for n in (len(digits), len(digits) - 2 * text.startswith("00")))


DOTS = [" dot ", "[dot]", "(dot)", " DOT ", " [.] ", "[.]", " (dot) "]


def _grouped(digits: str, sizes: list[int], sign: str) -> str:
    ends = np.cumsum(sizes).tolist()
    return sign.join(digits[a:b] for a, b in zip([0, *ends], [*ends, len(digits)]) if digits[a:b])


def _unknown(made, signs: list[str], rng: random.Random) -> str:
    """`made` with one of the signs, or with a slash, which no fixed pattern knows, where that gives another fixed value."""
    text = made(rng.choice(signs))
    return made("/") if base_spans(text) else text


def rewritten(text: str, kind: int, rng: random.Random) -> str:
    """A text of a kind in another form that the fixed patterns do not know; all of its letters and digits stay."""
    if kind == 0:
        local, known, domain = text.partition("@")
        if not known:
            return text
        at = rng.choice([" at ", " [at] ", " (at) ", "(at)", "[at]", " @ ", " AT ", "{at}", "[@]", "@"])
        # Behind a plain "@" every dot has another form, else the fixed pattern would know a part.
        dot = rng.choice(DOTS if at == "@" else [".", ".", *DOTS])
        if dot != "." and all(local.split(".")) and rng.random() < 0.5:
            local = local.replace(".", dot)
        return local + at + domain.replace(".", dot)
    if kind == 1:
        sign, parts = rng.choice(["[.]", " . ", "(.)", "[dot]", " dot ", "{.}", "(dot)"]), text.split(".")
        # All dots or only one of them.
        one = rng.randrange(1, len(parts)) if len(parts) > 1 and rng.random() < 0.3 else 0
        return parts[0] + "".join((sign if one in (0, i) else ".") + part for i, part in enumerate(parts[1:], 1))
    digits = _digits(text)
    if kind == 2:
        size = rng.choice([4, 4, 4, 6])
        sizes = [4, 6] if len(digits) in (14, 15) and size == 6 else [size] * (len(digits) // size)
        return _unknown(lambda sign: _grouped(digits, sizes, sign), [".", "  ", "/", " - ", "_"], rng)
    country, area, tail = _phone(digits)
    bracketed, lead = area and rng.random() < 0.6, rng.choice(["", "00", "00", "+"])

    def made(sign):
        # Before "/" the fixed pattern does not know a "+".
        start = {"": country, "00": "00" + country, "+": ("+" if sign == "/" else "") + country}[lead] if country else ""
        return sign.join(filter(None, [start, f"({area})" if bracketed else area, *tail]))

    return _unknown(made, [" ", ".", "-", "/"], rng)


def _phone(digits: str) -> tuple[str, str, list[str]]:
    """Country (at most 3 digits), area (at most 5 of the longest number) and the last digits of a phone number."""
    country = min(3, max(0, len(digits) - 10))
    return digits[:country], digits[country:-7], [part for part in (digits[-7:-4], digits[-4:]) if part]


def without_country(text: str, kind: int, rng: random.Random) -> str:
    """A phone number as it is written within its country; another kind in another form."""
    if kind != 3:
        return rewritten(text, kind, rng)
    _, area, tail = _phone(_digits(text))
    bracketed = area and rng.random() < 0.6
    return _unknown(lambda sign: sign.join(filter(None, [f"({area})" if bracketed else area, *tail])), [" ", ".", "-", "/"], rng)


# --- learning


def _cells(text: str, stride: int, width: int) -> list[int]:
    """Starts of the windows of a text that hold a mark."""
    marked = set()
    for pattern in (MARK, AT):
        for found in pattern.finditer(text):
            for at in {found.start(), min(found.end(), found.start() + width) - 1}:
                cell = at // stride
                marked.update(c for c in range(cell - width // stride + 1, cell + 1) if c >= 0)
    return [c * stride for c in sorted(marked)]


def _examples(documents: DataFrame, most: int) -> list[tuple[int, str, list]]:
    """Windows to learn from: (kind or -1, text, spans as (start, end, kind)), `most` of each kind.

    The documents' own spans are labels; without a column of them, those of the fixed patterns are.

    Those with the least hashes of their text are chosen among all of the documents (text, spans):
    evenly, once for each text, and the same however the rows are cut.  Each task, too, gives
    at most `most` of a kind.
    """
    labelled = "spans" in documents.columns
    schema = "kind int, rank bigint, piece string, spans array<struct<start: bigint, end: bigint, kind: string>>"

    def run(batches):
        heaps = {}
        for batch in sliced(batches):
            texts = strings(batch.column("text"))
            for text, spans in zip(texts, batch.column("spans").to_pylist() if labelled else texts):
                if labelled:
                    known = sorted((s["start"], s["end"], KINDS.index(s["kind"])) for s in spans or () if s["kind"] in KINDS)
                else:
                    known = base_spans(text)
                starts = {max(0, (a + b) // 2 - LEARNED // 2): k for a, b, k in known}
                for at in _cells(text, LEARNED, LEARNED):
                    if not any(a < at + LEARNED and b > at for a, b, _ in known):
                        starts[at] = -1
                for at, kind in starts.items():
                    piece = text[at:at + LEARNED]
                    own = [(a - at, b - at, k) for a, b, k in known if a >= at and b <= at + len(piece)]
                    # Pieces with a part of a span, or with spans that overlap, would teach wrong tags.
                    cut = any(a < at + len(piece) and b > at for a, b, k in known if (a - at, b - at, k) not in own)
                    if cut or any(x[1] > y[0] for x, y in zip(own, own[1:])):
                        continue
                    heap, seen = heaps.setdefault(kind, ([], set()))
                    rank = xxhash.xxh3_64_intdigest(piece) >> 1
                    if rank not in seen and (len(heap) < most or rank < -heap[0][0]):
                        seen.add(rank)
                        heapq.heappush(heap, (-rank, piece, own))
                        if len(heap) > most:
                            seen.discard(-heapq.heappop(heap)[0])
        rows = [(k, -r, piece, [{"start": a, "end": b, "kind": KINDS[j]} for a, b, j in own]) for k, (heap, _) in heaps.items() for r, piece, own in heap]
        columns = list(zip(*rows)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([
            pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()),
            pa.array(columns[3], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))),
        ], names=["kind", "rank", "piece", "spans"])

    rows = documents.select(F.col("text").cast("string").alias("text"), *["spans"] * labelled)
    found = rows.mapInArrow(run, schema)
    found = written(found.groupBy("kind", "rank", "piece").agg(F.min("spans").alias("spans")), "pieces")
    made = []
    for kind in range(-1, len(KINDS)):
        # At most `most` short rows.
        rows = found.filter(F.col("kind") == kind).orderBy("rank", "piece").limit(most).collect()
        made += [(kind, r.piece, [(s.start, s.end, KINDS.index(s.kind)) for s in r.spans]) for r in rows]
    return made


def _varied(piece: str, spans: list, rng: random.Random, other=rewritten) -> tuple[str, list]:
    """A piece with its spans in other forms."""
    parts, moved, at, size = [], [], 0, 0
    for a, b, k in spans:
        made = other(piece[a:b], k, rng)
        parts += [piece[at:a], made]
        size += a - at
        moved.append((size, size + len(made), k))
        size += len(made)
        at = b
    return "".join([*parts, piece[at:]]), moved


def _tags(spans: list, width: int) -> np.ndarray:
    tags = np.zeros(width, np.int64)
    for a, b, k in spans:
        tags[a:b] = 2 * k + 2
        tags[a] = 2 * k + 1
    return tags


def examples(labelled: DataFrame, sample=SAMPLE, forms=3, seed=0) -> tuple[np.ndarray, np.ndarray]:
    """Character classes and tags to learn from: labelled pieces, each `forms` times with its spans in other forms, and
    once more with phone numbers that lack their country."""
    rng, texts, tags = random.Random(seed), [], []
    for kind, piece, spans in _examples(labelled, sample):
        others = [rewritten] * forms if kind >= 0 else []
        if others and any(k == 3 for _, _, k in spans):
            others.append(without_country)
        for other in [None, *others]:
            text, moved = _varied(piece, spans, rng, other) if other else (piece, spans)
            # A longer form moves the window on, and must still be in it as a whole.
            if len(text) > LEARNED and moved:
                shift = max(0, min(moved[0][0], moved[-1][1] - LEARNED + 8))
                text, moved = text[shift:shift + LEARNED], [(a - shift, b - shift, k) for a, b, k in moved]
            if all(b <= LEARNED for _, b, _ in moved):
                texts.append(encoded(text, LEARNED))
                tags.append(_tags(moved, LEARNED))
    shape = (len(texts), LEARNED)
    return np.array(texts, np.int64).reshape(shape), np.array(tags, np.int64).reshape(shape)


def fit(labelled: DataFrame, sample=SAMPLE, hidden=16, epochs=14, seed=0) -> Tagger | None:
    """Learn from labelled documents (text, spans: array of (start, end, kind)); None without a labelled span.

    Without the column spans, the spans of the fixed patterns are learned from.

    At most `sample` pieces of each kind, and as many without any, are learned from.
    """
    ids, tags = examples(labelled, sample, seed=seed)
    if not tags.any():
        return None
    tagger = Tagger(len(KINDS), hidden, seed)
    tagger.train(ids, tags, epochs, seed=seed)
    return tagger


# --- finding


def _pieces(tags: np.ndarray, sure: np.ndarray) -> list[tuple[int, int, int, float]]:
    """(start, end, kind, sum of sureness) of the spans in a row of tags."""
    out = []
    for i in np.flatnonzero(tags).tolist():
        if tags[i] % 2 or not out or out[-1][1] != i:
            out.append([i, i + 1, (tags[i] - 1) // 2, sure[i]])
        else:
            out[-1][1] = i + 1
            out[-1][3] += sure[i]
    return [tuple(x) for x in out]


def reconciled(found: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float]]:
    """Of spans (start, end, kind, weight) the set without overlaps that weighs most in all; ties to the earlier end."""
    found = sorted(set(found), key=lambda s: (s[1], s[0], s[2]))
    ends = [s[1] for s in found]
    best = [(0.0, None, None)]  # weight, span taken, how many were open to it
    for i, s in enumerate(found):
        before = bisect_right(ends, s[0], 0, i)
        taken = best[before][0] + s[3]
        best.append((taken, s, before) if taken > best[i][0] else (best[i][0], None, i))
    out, i = [], len(found)
    while i:
        _, span, before = best[i]
        if span:
            out.append(span)
        i = before
    return out[::-1]


def _joined(found: list, length: int) -> list:
    """Spans of the overlapping windows of a text (start, end, kind, weight, window) with the parts of those that a window's edge cuts put together."""
    whole, open_ = [], []
    for a, b, k, w, at in sorted(found):
        cut_left, cut_right = a == at and a > 0, b == at + WINDOW and b < length
        if not cut_left and not cut_right:
            whole.append((a, b, k, w))
            continue
        if open_ and open_[-1][2] == k and open_[-1][1] >= a:
            last = open_[-1]
            sure = max(last[3] / (last[1] - last[0]), w / (b - a))
            start, end = min(last[0], a), max(last[1], b)
            open_[-1] = (start, end, k, sure * (end - start))
        else:
            open_.append((a, b, k, w))
    return whole + open_


def _fitting(text: str, a: int, b: int, kind: int) -> tuple[int, int, int] | None:
    """The longest run of whole words of a span that holds the exact check of its kind, or else of another.

    A tagger may take a word too many, and mix up kinds that look alike.
    """
    while a and text[a - 1].isalnum() and text[a].isalnum():
        a -= 1
    while b < len(text) and text[b - 1].isalnum() and text[b].isalnum():
        b += 1
    if b - a > 2 * WINDOW:
        return None
    words = [(m.start(), m.end()) for m in WORD.finditer(text, a, b)]
    for size in range(len(words), 0, -1):
        for i in range(len(words) - size + 1):
            c, d = words[i][0], words[i + size - 1][1]
            for k in sorted(range(len(KINDS)), key=lambda k: k != kind):
                if holds(k, text[c:d]):
                    return c, d, k
    return None


def _more(texts: list[str], base: list[list], tagger: Tagger) -> list[list[tuple[int, int, int]]]:
    """What the tagger finds in texts beside the base spans."""
    places = [(i, at) for i, text in enumerate(texts) for at in _cells(text, STRIDE, WINDOW)]
    found = {}
    for block in range(0, len(places), BLOCK):
        own = places[block:block + BLOCK]
        ids = np.stack([encoded(texts[i][at:at + WINDOW], WINDOW) for i, at in own])
        tags, sure = tagger.decoded(ids)
        tags[ids == PAD] = 0
        for row in np.flatnonzero(tags.any(axis=1)).tolist():
            i, at = own[row]
            found.setdefault(i, []).extend((at + a, at + b, k, w, at) for a, b, k, w in _pieces(tags[row], sure[row]))
    out = [[] for _ in texts]
    for i, spans in found.items():
        text, taken = texts[i], sorted(base[i])
        reach = np.maximum.accumulate([b for _, b, _ in taken]) if taken else []
        good = []
        for a, b, k, w in _joined(spans, len(text)):
            sure = w / (b - a)
            fitting = _fitting(text, a, b, k) if sure >= SURE else None
            if fitting:
                a, b, k = fitting
                last = bisect_right(taken, (b - 1, len(text) + 1, 9)) - 1
                if last < 0 or reach[last] <= a:
                    good.append((a, b, k, sure * (b - a)))
        out[i] = [s[:3] for s in reconciled(good)]
    return out


SPANS = "array<struct<start: bigint, end: bigint, kind: string, base: boolean>>"


def _each(documents: DataFrame, tagger: Tagger | None, name: str, kind: str, made) -> DataFrame:
    """(doc_id, `name`) of each row: what `made` gives for a text and its spans as (start, end, kind, whether base)."""
    copied = None if tagger is None else documents.sparkSession.sparkContext.broadcast(tagger.plain())

    def run(batch):
        texts = strings(batch.column("text"))
        base = [base_spans(t) for t in texts]
        more = [[] for _ in texts]
        if copied is not None:
            kinds, hidden, seed, values = copied.value
            more = _more(texts, base, Tagger(kinds, hidden, seed, values))
        every = [sorted([*((*s, True) for s in a), *((*s, False) for s in b)], key=lambda s: (s[0], s[2])) for a, b in zip(base, more)]
        return {"doc_id": batch.column("doc_id"), name: [made(t, spans) for t, spans in zip(texts, every)]}

    rows = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    return per_batch(rows, run, f"doc_id {dict(documents.dtypes)['doc_id']}, {name} {kind}")


def scan(documents: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """(doc_id, spans: array of (start, end, kind, base)) for every row of documents (doc_id, text).

    Places are code points, the end is exclusive; spans are ordered by start, then by kind.  Spans of
    the fixed patterns all stay, whatever they overlap.  A tagger adds what it finds beside them: every window of
    a text that holds a mark is read, spans that windows' edges cut are put together, and of all spans of the text
    those stay that are sure, hold the exact check of their kind, and weigh most without overlaps.  A missing or
    empty text has no spans; repeated rows each give a row; other columns are not looked at.
    """
    def made(_, spans):
        return [{"start": a, "end": b, "kind": KINDS[k], "base": known} for a, b, k, known in spans]

    return _each(documents, tagger, "spans", SPANS, made)


def _masked(text: str, spans: list) -> str:
    parts, at = [], 0
    for a, b, k, _ in spans:
        if a >= at:
            parts += [text[at:a], f"<{KINDS[k]}>"]
        at = max(at, b)
    return "".join([*parts, text[at:]])


def redact(documents: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """(doc_id, text) of every row of documents with each span of `scan` replaced by its kind in angle brackets.

    Where spans overlap, the first one's kind stands for all of them.  A missing text becomes an empty one.
    """
    return _each(documents, tagger, "text", "string", _masked)
