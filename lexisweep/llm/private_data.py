"""Personal data by weak supervision: labellers vote on spans, a classifier decides.

1. Patterns propose spans.  Those of the four base kinds stay whatever is thought of
   them; those of the loose kinds are only candidates.
2. Labellers vote on every span: patterns (is it well formed, does it stand alone),
   gazetteers (endings, calling codes, given names, values of manuals) and context
   (which words stand before it).  Nobody says how good they are:
   expectation-maximisation estimates it from how often each pattern of votes occurs,
   at most 3 ** 8 rows whatever the corpus.
3. Its posteriors label a bounded sample of spans, on which a logistic classifier over
   hashed features is trained.  Loose spans that it takes for personal data are added.

Texts are read once; what is found is a narrow table.
"""

import json
import re
import zlib

import numpy
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexisweep.llm.quality import fit_scorer, fit_votes
from lexisweep.staging import staged

# Kinds in their order: the first BASE always stay.
KINDS = ("email", "ip", "card", "phone", "mail", "tel", "iban", "number", "name")
BASE = 4
EMAIL, IP, CARD, PHONE, MAIL, TEL, IBAN, NUMBER, NAME = range(len(KINDS))

# Spans of either posterior label, at most, that the classifier is trained on.
SAMPLE = 2048

# Hash buckets of features.
BUCKETS = 1024

# Score from which on a loose span is added.
ADD = 0.5

# Characters and words of context on either side.
_NEAR, _WORDS = 48, 3

# The base patterns.  Local parts are found backwards from the sign, and
# digits start where none stands before, which gives the same spans in linear time.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_ADDRESS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CHAIN = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# The loose patterns.
_SPOKEN = re.compile(
    r"\x20?[\[(]\x20?at\x20?[\])]\x20?[A-Za-z0-9-]+"
    r"(?:(?:\x20?[\[(]\x20?dot\x20?[\])]\x20?|\.)[A-Za-z0-9-]+)+"
)
_TEL = re.compile(r"(?<![0-9+(.-])\(?[0-9]{2,4}\)?[\x20./-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_NAME = re.compile(r"(?<![A-Za-z])[A-Z][a-z]+\x20[A-Z][a-z]+(?![a-z])")

# Gazetteers.
GIVEN_NAMES = frozenset(
    """Adam Alice Andreas Anna Anne Antonio Barbara Carlos Carmen Charles Christine Claire
    Daniel David Elena Elizabeth Emma Francisco Franz Hans Hélène Isabel James Jan Jean
    Jennifer John José Juan Julia Karl Katharina Klaus Laura Linda Lucía Luis Maria Marie
    Martin Mary Michael Michel Nicolas Patricia Paul Peter Pierre Robert Sabine Sarah Sophie
    Stefan Susan Thomas Ursula William Wolfgang""".split()
)
ENDINGS = frozenset("com org net edu gov mil info biz io de fr es it uk us eu ch at nl be".split())
CALLING_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43",
                 "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "58", "60",
                 "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93")
ISSUERS = ("34", "36", "37", "38", "4", "51", "52", "53", "54", "55", "6011", "65", "22", "35")
SAMPLES = frozenset(
    """4111111111111111 4242424242424242 5555555555554444 378282246310005 1.2.3.4 0.0.0.0
    127.0.0.1 255.255.255.255 8.8.8.8 1.1.1.1 user@example.com you@example.com
    name@example.com john.doe@example.com someone@example.com""".split()
)
CONTACT_WORDS = frozenset(
    """account address adresse call card cell contact courriel correo e-mail email from iban ip
    kontakt konto mail mobile name phone tarjeta tel telefon teléfono telephone téléphone tlf
    visa mastercard whatsapp dear mr mrs ms dr herr frau señor señora monsieur madame""".split()
)
OTHER_WORDS = frozenset(
    """build chapter code doi error fig figure id invoice isbn issn item line model no nr number
    order page part price ref release revision section serial step sum table total v version
    vol volume""".split()
)


def luhn(digits):
    total = sum(map(int, digits[-1::-2]))
    return (total + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])) % 10 == 0


def _digits(value):
    return "".join(c for c in value if "0" <= c <= "9")


def base_spans(text):
    """(start, kind, end) of the base kinds, sorted, and the chains of digits of a
    card's length that fail the card's test."""
    found, failing, has_digit = [], [], re.search("[0-9]", text)
    stop = sign = 0
    if "@" in text:
        for match in _HOST.finditer(text):
            at = match.start()
            # From the last sign or span: no local part reaches back over either.
            head = text[max(stop, text.rfind("@", sign, at) + 1) : at]
            sign = at
            start = at - (len(head) - len(head.rstrip(_LOCAL)))
            if start < at:
                stop = match.end()
                found.append((start, EMAIL, stop))
    if has_digit:
        for match in _ADDRESS.finditer(text):
            parts = [p.lstrip("0") for p in match[0].split(".")]
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                found.append((match.start(), IP, match.end()))
        for match in _CHAIN.finditer(text):
            if len(match[0]) >= 12 and 12 <= len(digits := _digits(match[0])) <= 19:
                if luhn(digits):
                    found.append((match.start(), CARD, match.end()))
                else:
                    failing.append((match.start(), NUMBER, match.end()))
    if "+" in text:
        for match in _PHONE.finditer(text):
            if 9 <= len(_digits(match[0])) <= 15:
                found.append((match.start(), PHONE, match.end()))
    return sorted(found), failing


def loose_spans(text, base, failing):
    """(start, kind, end) of the loose kinds that overlap no base span and none of
    an earlier loose one."""
    found = list(failing)
    if "at" in text and ("(" in text or "[" in text):
        last = 0
        for match in _SPOKEN.finditer(text):
            at = match.start()
            head = text[max(last, at - _NEAR) : at]
            start = at - (len(head) - len(head.rstrip(_LOCAL)))
            if start < at:
                last = match.end()
                found.append((start, MAIL, last))
    found += [(m.start(), TEL, m.end()) for m in _TEL.finditer(text) if 7 <= len(_digits(m[0])) <= 12]
    found += [(m.start(), IBAN, m.end()) for m in _IBAN.finditer(text)]
    for match in _NAME.finditer(text):
        if match[0].partition(" ")[0] in GIVEN_NAMES:
            found.append((match.start(), NAME, match.end()))
    taken, kept = sorted((start, end) for start, _, end in base), []
    reached = place = 0
    for start, kind, end in sorted(found):
        while place < len(taken) and taken[place][0] < end:
            reached = max(reached, taken[place][1])
            place += 1
        if start >= reached:
            kept.append((start, kind, end))
            reached = max(reached, end)
    return kept


def _sum_of_iban(value):
    plain = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


# Labellers.  Each takes kind, value, the characters on either side ("" at an end) and
# the lower-case words before; True is personal, False is not, None abstains.


def _checked(kind, value, sides, words):
    if kind in (CARD, NUMBER):
        return luhn(_digits(value))
    return _sum_of_iban(value) if kind == IBAN else None


def _alone(kind, value, sides, words):
    return not any(c.isalnum() or c in "_=/\\" for c in sides if c)


def _well_formed(kind, value, sides, words):
    digits = _digits(value)
    if kind in (EMAIL, MAIL):
        return value[-1].isalpha() and value[0].isalnum()
    if kind in (CARD, NUMBER):
        return len(digits) in (15, 16)
    if kind in (PHONE, TEL):
        return (" " in value or "-" in value) if len(digits) >= 10 else False
    return None


def _known(kind, value, sides, words):
    if kind in (EMAIL, MAIL):
        return re.split(r"[^A-Za-z]", value)[-1].lower() in ENDINGS
    if kind in (CARD, NUMBER):
        return _digits(value).startswith(ISSUERS)
    if kind == PHONE:
        return value[1:].startswith(CALLING_CODES)
    if kind == IP:
        return not value.startswith(("0.", "10.", "127.", "169.254.", "192.168.", "255."))
    return True if kind == NAME else None


def _no_sample(kind, value, sides, words):
    digits = _digits(value)
    if value in SAMPLES or digits in SAMPLES or (len(digits) > 3 and len(set(digits)) == 1):
        return False
    return None


def _contact(kind, value, sides, words):
    return True if any(w in CONTACT_WORDS for w in words) else None


def _other(kind, value, sides, words):
    return False if any(w in OTHER_WORDS for w in words) else None


def _in_prose(kind, value, sides, words):
    if not words:
        return None
    if words[-1].isalpha():
        return True
    return False if any("0" <= c <= "9" for c in words[-1]) else None


LABELLERS = (_checked, _alone, _well_formed, _known, _no_sample, _contact, _other, _in_prose)
_VOTE = {True: "g", False: "b", None: "-"}


def votes(text, start, kind, end):
    """One letter per labeller: g (personal), b (not) or -; and the words before."""
    value = text[start:end]
    sides = (text[start - 1 : start] if start else "", text[end : end + 1])
    before = text[max(0, start - _NEAR) : start].lower().split()[-_WORDS:]
    words = [w.strip(".,;:()[]\"'") for w in before]
    return "".join(_VOTE[f(kind, value, sides, words)] for f in LABELLERS), words


def features(text, start, kind, end, words):
    """Buckets: the kind with the shape, size and pairs of the value, the characters
    beside it, and the words around."""
    value = text[start:end]
    shape = re.sub("[a-z]+", "a", re.sub("[A-Z]+", "A", re.sub("[0-9]+", "0", value)))[:24]
    classes = re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", value[:64])))
    after = [w.strip(".,;:()[]\"'") for w in text[end : end + _NEAR].lower().split()[:_WORDS]]
    told = [f"kind {kind}", f"shape {kind} {shape}", f"size {kind} {min(end - start, 32)}"]
    told += {f"pair {kind} {a}{b}" for a, b in zip(classes, classes[1:])}
    told += [f"left {kind} {_class(text[start - 1 : start] if start else '')}"]
    told += [f"right {kind} {_class(text[end : end + 1])}"]
    told += [f"before {w}" for w in words] + [f"after {w}" for w in after]
    return sorted({zlib.crc32(f.encode("utf-8", "replace")) % BUCKETS for f in told})


def _class(c):
    if not c or c.isspace():
        return " "
    return "0" if c.isdigit() else "a" if c.isalpha() else c


_SPAN = pa.struct(
    [
        ("start", pa.int32()),
        ("kind", pa.int32()),
        ("end", pa.int32()),
        ("votes", pa.string()),
        ("features", pa.list_(pa.int32())),
    ]
)
_SPANS = "array<struct<start:int,kind:int,end:int,votes:string,features:array<int>>>"


def _proposed(docs):
    """(doc_id, row, spans), one per row; staged, the only pass over the texts."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def propose(batches):
        for batch in batches:
            found = []
            for text in batch.column("text"):
                text = text.as_py() or ""
                base, failing = base_spans(text)
                spans = []
                for span in sorted(base + loose_spans(text, base, failing)):
                    letters, words = votes(text, *span)
                    spans.append((*span, letters, features(text, *span, words)))
                found.append([dict(zip(("start", "kind", "end", "votes", "features"), s)) for s in spans])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found, pa.list_(_SPAN))], ["doc_id", "spans"]
            )

    rows = docs.select("doc_id", "text").mapInArrow(propose, f"doc_id {id_type}, spans {_SPANS}")
    return staged(rows.withColumn("row", F.monotonically_increasing_id()), "proposed")


def train(spans: DataFrame, sample: int = SAMPLE):
    """(weights, bias, {pattern: posterior}) from the rows (row, start, kind, end,
    votes, features).

    What is trained on are the spans of least hash, at most ``sample`` of either
    label, and equal votes and features once.  If all have one label the classifier is
    constant on that side.
    """
    counts = spans.groupBy("votes").count().collect()  # at most 3 ** 8 rows
    posterior = fit_votes({r["votes"]: r["count"] for r in counts})
    good = [p for p, value in posterior.items() if value > 0.5]
    key = F.xxhash64("votes", "features")
    rows = []
    for side in (F.col("votes").isin(good), ~F.col("votes").isin(good)):
        chosen = spans.filter(side).select(key.alias("key"), "votes", "features").distinct()
        rows.append(chosen.orderBy("key").limit(sample).collect())  # at most ``sample``
    if not all(rows):
        return numpy.zeros(BUCKETS), (50.0 if rows[0] else -50.0), posterior
    every = rows[0] + rows[1]
    x = numpy.zeros((len(every), BUCKETS), dtype=numpy.float32)
    for k, row in enumerate(every):
        x[k, row["features"]] = 1 / numpy.sqrt(len(row["features"]))
    weights, bias = fit_scorer(x, numpy.array([posterior[r["votes"]] for r in every]))
    return weights, bias, posterior


def find_private(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, spans) per row: an array of (start, kind, end, posterior, score), by
    start and kind; places in code points, end exclusive, kinds as in KINDS.

    Spans of the base kinds are all there; loose ones if their score is ADD or more.
    A null text is empty; without spans the array is.  Spans of one kind do not
    overlap; of overlapping base spans of several kinds all stay.  Repeated rows get a
    result each, null ids are no exception.  An empty table gives an empty one.  Texts
    of any length take time in proportion.  Only ``doc_id`` and ``text`` are read.
    """
    rows = _proposed(docs)
    each = rows.select("row", F.explode("spans").alias("span")).select("row", "span.*")
    weights, bias, posterior = train(each, sample)
    of_bucket = F.from_json(F.lit(json.dumps([float(w) for w in weights])), "array<double>")
    of_votes = F.from_json(F.lit(json.dumps(posterior)), "map<string,double>")

    def judged(s):
        size = F.sqrt(F.size(s["features"]))
        total = F.aggregate(
            s["features"], F.lit(0.0), lambda sum_, f: sum_ + F.get(F.col("__weights"), f) / size
        )
        return F.struct(
            s["start"].alias("start"),
            s["kind"].alias("kind"),
            s["end"].alias("end"),
            F.coalesce(F.element_at(F.col("__votes"), s["votes"]), F.lit(0.5)).alias("posterior"),
            (1 / (1 + F.exp(-(total + F.lit(float(bias)))))).alias("score"),
        )

    scored = rows.withColumns({"__weights": of_bucket, "__votes": of_votes})
    found = F.filter(
        F.transform("spans", judged), lambda s: (s["kind"] < BASE) | (s["score"] >= ADD)
    )
    return scored.select("doc_id", found.alias("spans"))


def digests(found: DataFrame) -> DataFrame:
    """(doc_id, n_<base kind>..., base_sha256, spans, n_added) of ``find_private``."""
    names = F.array(*(F.lit(name) for name in KINDS))
    written = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])
    listed = lambda spans: F.array_join(F.transform(spans, written), ",")
    count = lambda test: F.size(F.filter("spans", test)).cast("bigint")
    return found.select(
        "doc_id",
        *(count(_is_kind(k)).alias(f"n_{KINDS[k]}") for k in range(BASE)),
        F.sha2(listed(F.filter("spans", lambda s: s["kind"] < BASE)), 256).alias("base_sha256"),
        listed("spans").alias("spans"),
        count(lambda s: s["kind"] >= BASE).alias("n_added"),
    )


def _is_kind(kind):
    return lambda span: span["kind"] == kind
