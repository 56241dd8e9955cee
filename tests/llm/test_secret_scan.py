"""The randomness battery against a plain version, and what it finds and leaves."""

import collections
import math
import random
import re
import time

import pytest

from inkstrata.llm import secret_scan as scan

TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}")
BASE = [re.compile(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]{12,})", re.A), re.compile("(AKIA[A-Z0-9]{14,})"), re.compile("([0-9a-f]{16,})")]
WORDS = "the quick brown fox jumps over lazy dog get user name from id request http server response handler main config path value index list array string parse token release candidate build version update service manager factory module internationalization library common utils".split()


def plain_p(token):
    """(encoding, doubling of the length, p-value), or None where no encoding fits."""
    found = next((e for e in scan.ENCODINGS if re.fullmatch(e[1].strip("^$"), token)), None)
    if not found:
        return None
    name, _, alphabet, (symbols, change, mix, equal, triple) = found
    n, k = len(token), len(alphabet)
    v = [alphabet.index(c) for c in token]
    squares = sum(x * x for x in collections.Counter(token).values())
    changes = sum((a in symbols) != (b in symbols) for a, b in zip(token, token[1:], strict=False))
    mixes = sum(a.isdigit() != b.isdigit() for a, b in zip(token, token[1:], strict=False))
    mean = sum(v) / n
    spread = sum((x - mean) ** 2 for x in v)
    serial = sum((a - mean) * (b - mean) for a, b in zip(v, v[1:], strict=False)) / spread if spread else 1.0
    tail = lambda z: 0.5 * math.erfc(min(max(z, -35), 35) / math.sqrt(2))
    share = sum(c in symbols for c in alphabet) / k
    q = 2 * share * (1 - share)
    uniform = (k / n * squares - n - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n)
    run = (changes - (n - 1) * q) / math.sqrt((n - 1) * q * (1 - q) + 2 * (n - 2) * (q / 2 - q * q))
    if 3 * min(tail(uniform), 2 * tail(abs(run)), 2 * tail(abs((serial + 1 / n) * math.sqrt(n)))) < scan.RANDOM_LEAST:
        return name, int(math.log2(n)), 1.0
    pairs = n * (n - 1) / 2
    scores = [((squares - n) / 2 + 0.5 - pairs * equal) / math.sqrt(pairs * equal * (1 - equal) + pairs * (n - 2) * 2 * (triple - equal * equal))]
    if change is not None:
        scores.append((changes + 0.5 - (n - 1) * change) / math.sqrt((n - 1) * change * (1 - change)))
    if mix is not None:
        scores.append(-(mixes - 0.5 - (n - 1) * mix) / math.sqrt((n - 1) * mix * (1 - mix)))
    return name, int(math.log2(n)), tail(-sum(scores) / math.sqrt(len(scores)))


def plain_spans(texts):
    """doc -> spans of the method, by the step-up procedure on sorted p-values (taken at their bins' upper ends)."""
    tokens = [(i, m.start(), m.end(), p) for i, t in texts.items() for m in TOKEN.finditer(t or "") if (p := plain_p(m[0]))]
    groups = collections.defaultdict(list)
    for *_, (name, size, p) in tokens:
        groups[name, size].append(math.exp(-min(scan.BINS - 1, math.floor(-math.log(max(p, 1e-300)) / scan.BIN_WIDTH)) * scan.BIN_WIDTH))
    cut = {}
    for key, ps in groups.items():
        ps.sort()
        cut[key] = max((p for k, p in enumerate(ps, 1) if p <= k * scan.FALSE_SHARE / len(ps)), default=-1.0)
    out = collections.defaultdict(list)
    for i, a, b, (name, size, p) in tokens:
        base = [m.span() for pattern in BASE for m in pattern.finditer(texts[i])]
        if p <= cut[name, size] and not any(x <= a and b <= y for x, y in base):
            out[i].append((a, b))
    return out


def made_texts(seed=5, n=400):
    rng = random.Random(seed)
    alphabets = [scan.LOWER, scan.LOWER + scan.UPPER, scan.DIGITS + scan.LOWER, scan.DIGITS + scan.LOWER + scan.UPPER, scan.DIGITS + scan.LOWER + scan.UPPER + "+/", scan.DIGITS + scan.LOWER + scan.UPPER + "-_+", scan.DIGITS + "ABCDEF"]
    joints = ["".join, "_".join, "-".join, "/".join, lambda w: "".join(x.capitalize() for x in w), lambda w: "".join(w).upper()]
    texts, secret = {}, {}
    for i in range(n):
        if i % 3 == 0:
            token = "".join(rng.choice(alphabets[i // 3 % 7]) for _ in range(rng.choice([24, 40, 64])))
            texts[i], secret[i] = f"see {token}, here", (4, 4 + len(token))
        else:
            texts[i] = f"see {rng.choice(joints)(rng.choices(WORDS, k=rng.randrange(4, 12)))} and {rng.choice(joints)(rng.choices(WORDS, k=5))}{rng.randrange(3000)} there"
    texts |= {n: None, n + 1: "", n + 2: "a" * 40 + "1" * 20, n + 3: "Ab" * 20, n + 4: "2024-01-01/2024-02-02", n + 5: "1234567890" * 4, n + 6: "password: Zq81mPx0LwT6vRb2NcYs9KdE " + "550e8400-e29b-41d4-a716-446655440000"}
    return texts, secret


def test_battery_against_a_plain_version(spark):
    texts, secret = made_texts()
    docs = spark.createDataFrame([(i, t, "x", 0.5) for i, t in texts.items()], "doc_id long, text string, candidates string, p double")
    got = {r["doc_id"]: [tuple(map(int, s.split(":")[1:])) for s in r["spans"].split(",") if s.startswith("random")] for r in scan.secrets(docs).collect()}
    wanted = plain_spans(texts)
    assert {i: s for i, s in got.items() if s} == dict(wanted)
    found = sum(secret[i] in got[i] for i in secret)
    false = sum(len(s) for i, s in got.items() if i not in secret)
    assert found >= 0.75 * len(secret)  # random tokens of 24 to 64 symbols, letters alone among them
    assert false <= 2 * scan.FALSE_SHARE * found and not any(got[i] for i in range(400, 407))


def test_p_values_of_ordinary_tokens_are_not_too_small():
    texts, secret = made_texts(6, 3000)
    ps = [p[2] for i, t in texts.items() if i not in secret for m in TOKEN.finditer(t or "") if (p := plain_p(m[0]))]
    assert len(ps) > 2000
    for least in (0.1, 0.05, 0.01):
        assert sum(p <= least for p in ps) <= 1.2 * least * len(ps)


@pytest.mark.parametrize("text", ["token=abcdefghijkl " * 4000, "0123456789abcdef " * 6000, "x" * 300_000])
def test_texts_with_many_matches(spark, text):
    began = time.time()
    row = scan.secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    expected = [f"assign:{m.start()}:{m.end()}" for m in BASE[0].finditer(text)] or [f"hex:{m.start()}:{m.end()}" for m in BASE[2].finditer(text)]
    assert [s for s in row["spans"].split(",") if s] == expected and time.time() - began < 60
    assert scan.redact(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["text"] == re.sub("token=abcdefghijkl|0123456789abcdef", scan.MASK, text)
