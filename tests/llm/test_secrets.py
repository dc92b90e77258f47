import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from lexisweep.llm import registered, secrets

ASSIGN = re.compile(
    r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
)
OPAQUE = re.compile("[A-Za-z0-9+/_-]{20,}")


def base_spans(text):
    found = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), m[0]) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), m[0]) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def live_spans(rows):
    """(start, end) of each row's live-looking spans, sorted."""
    spans, live = judged(rows)
    return [sorted({(a, b) for a, _, b, v in found if live(v)}) for found in spans]


def judged(rows):
    """rows: (doc_id, text, owner, repository)."""
    spans, owners, repositories = [], defaultdict(set), defaultdict(set)
    for _, text, owner, repository in rows:
        text = text or ""
        base = base_spans(text)
        more = [
            (m.start(), 3, m.end(), m[0])
            for m in OPAQUE.finditer(text)
            if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])
            and not any(a < m.end() and m.start() < b for a, _, b, _ in base)
        ]
        spans.append(sorted(base + more))
        for _, _, _, value in spans[-1]:
            owners[value].add(owner or "")
            repositories[value].add(repository or "")
    return spans, lambda v: not (len(owners[v]) >= 5 and len(repositories[v]) >= 5)


def expected(rows):
    out = []
    spans, live = judged(rows)
    for (i, text, _, _), found in zip(rows, spans):
        text_of = lambda s: ",".join(f"{secrets.KINDS[k][0]}:{a}:{b}" for a, k, b, _ in s)
        base = [s for s in found if s[1] < 3]
        every = [s for s in found if s[1] < 3 or live(s[3])]
        out.append((
            i, *(sum(s[1] == k for s in found) for k in range(3)),
            hashlib.sha256(text_of(base).encode()).hexdigest(), text_of(every),
            sum(live(s[3]) for s in found),
        ))
    return out


KEY = "f00dfeed" * 4
ROWS = [
    (1, f"é token = '{KEY}' and password:abc secret=hunter2x", "o1", "r1"),
    (1, f"é token = '{KEY}' and password:abc secret=hunter2x", "o1", "r1"),
    (2, None, None, None),
    (3, "", "o1", "r1"),
    (None, "AKIA" + "Z9" * 8 + " AKIAshort PassWord=token:abcdefgh", None, "r"),
    (5, "the live-opaque-token-1234567890 x", "o2", "r2"),
    (6, "plain words " * 20_000 + "apikey: 'zzzzzz9'", "o3", "r3"),
    *((10 + k, "common passwd=changeme1 Abcdefghij0123456789xyz", f"o{k}", f"r{k}") for k in range(6)),
]
SCHEMA = "doc_id long, text string, owner string, repo string, start int, kind string, digest string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "k", "d") for r in rows], SCHEMA)


def test_spans(spark):
    out = secrets.find_secrets(frame(spark, ROWS), F.col("owner"), F.col("repo"))
    key = lambda r: (r[0] is None, *map(str, r))
    assert sorted(map(tuple, out.collect()), key=key) == sorted(expected(ROWS), key=key)
    empty = secrets.find_secrets(frame(spark, ROWS).limit(0), F.col("owner"), F.col("repo"))
    assert empty.collect() == []


def test_mask(spark):
    docs = frame(spark, ROWS)
    out = secrets.mask_secrets(docs, F.col("owner"), F.col("repo"))
    assert out.columns == docs.columns
    rows = out.collect()
    assert len(rows) == len(ROWS)
    texts = defaultdict(list)
    for r in rows:
        texts[r.doc_id].append(r.text)
    assert texts[1] == ["é [secret]' and password:abc [secret]"] * 2
    assert texts[2] == [None] and texts[3] == [""]
    assert texts[None] == ["[secret] AKIAshort PassWord=token:abcdefgh"]
    assert texts[5] == ["the [secret] x"]
    assert texts[6] == ["plain words " * 20_000 + "[secret]'"]
    assert texts[12] == ["common passwd=changeme1 Abcdefghij0123456789xyz"]


def test_query(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    rows = [(r.doc_id, r.text, r.source, "/".join(x for x in (r.source, r.lang) if x)) for r in docs]
    out = registered.QUERIES["op5_secrets"](spark, data)
    assert sorted(map(tuple, out.collect())) == sorted(expected(rows))
    assert out.columns[:6] == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
