"""Secret scans: fixed patterns, and a battery of randomness tests.

Only DataFrame and SQL functions run here.  Fixed patterns give the base spans.
The method adds tokens that look random: a token's encoding is inferred from its
characters, and three tests ask whether it could be random in that encoding:

* chi-squared: are the alphabet's symbols equally frequent?
* runs: do symbols of the alphabet's halves alternate as chance would have it?
* serial correlation: does a symbol tell anything about the next one?

The tests are read against two hypotheses.  A token can only be secret if none
of the three rules out that its symbols are random (``RANDOM_LEAST``).  And the
null hypothesis, that it is ordinary text (a name, a path, words in a row), has
to be rejected: the alphabet's use is held against that of running text, the
runs of vowels and other symbols against those of syllables, the runs of digits
against those of numbered names.  The
Benjamini-Hochberg procedure works on these p-values by encoding and by doubling
of the length, so at most ``FALSE_SHARE`` of the tokens reported in each are
ordinary; short tokens give the tests little power and need much evidence.

The procedure runs on counts of p-values in fixed bins: a table whose size does
not depend on the corpus.  The scan itself never shuffles a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstrata.llm.common import materialise, text_of

# The base patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
#: A run is matched whole from its first possible start, so asking for the length inside the pattern drops the same matches.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Tokens that the battery looks at: from their first character, without padding.
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}"

#: Share of ordinary tokens among those that the procedure reports.
FALSE_SHARE = 0.05
#: Least p-value of "random" (the smallest of three tests, times three) of a token that may be secret.
RANDOM_LEAST = 0.002
BINS, BIN_WIDTH = 400, 0.1
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
VOWELS = "AEIOUaeiou"
#: Models of ordinary tokens: symbols that the runs are about, how often neighbours differ in being one of them, how
#: often in being a digit, how often two symbols of a token are equal, and how often three are.  Letter frequencies and
#: syllables of European languages; where case or digits mix in, fewer symbols are equal; ordinary hexadecimal tokens
#: are numbers with few letters.  None: not looked at.
WORDS = (VOWELS, 0.55, None, 0.066, 0.0055)
MIXED_CASE = (VOWELS, 0.52, None, 0.055, 0.0042)
MIXED = (VOWELS, 0.52, 0.10, 0.055, 0.0042)
NUMBERS = ("ABCDEFabcdef", None, 0.15, 0.12, 0.025)
#: Inferred encodings, the first that fits: name, test, symbols, model of ordinary tokens.  Digits alone fit none:
#: ordinary numbers are as random as secret ones.
ENCODINGS = (
    ("hex", "^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$", DIGITS + "abcdef", NUMBERS),
    ("HEX", "^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$", DIGITS + "ABCDEF", NUMBERS),
    ("base26", "^[a-z]+$", LOWER, WORDS),
    ("BASE26", "^[A-Z]+$", UPPER, WORDS),
    ("base32", "^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+$", UPPER + "234567", MIXED),
    ("base36", "^(?=.*[a-z])[0-9a-z]+$", DIGITS + LOWER, MIXED),
    ("BASE36", "^(?=.*[A-Z])[0-9A-Z]+$", DIGITS + UPPER, MIXED),
    ("base52", "^[A-Za-z]+$", UPPER + LOWER, MIXED_CASE),
    ("base62", "^(?=.*[A-Za-z])[0-9A-Za-z]+$", DIGITS + UPPER + LOWER, MIXED),
    ("base64", "^(?=.*[A-Za-z])[0-9A-Za-z+/]+$", UPPER + LOWER + DIGITS + "+/", MIXED),
    ("base64url", "^(?=.*[A-Za-z])[0-9A-Za-z_-]+$", UPPER + LOWER + DIGITS + "-_", MIXED),
    ("base66", "^(?=.*[A-Za-z])[0-9A-Za-z+/_-]+$", UPPER + LOWER + DIGITS + "+/-_", MIXED),
)
MASK = "[SECRET]"
#: Matches whose places are added up together.
CHUNK = 256
KINDS = ("assign", "access", "hex", "random")


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def places(text: str, pattern: str, group: int | None = None) -> Column:
    """array<struct<start, end, value>> of the leftmost non-overlapping matches, in code points, end exclusive.

    What lies between matches comes from ``split``: lengths of both add up to
    the places.  Texts without a match cost one search.  Places are added up
    ``CHUNK`` at a time, so that a text with very many matches is not copied for each.
    """
    p = _quoted(pattern)
    value = f"regexp_extract_all({text}, {p}, {group or 0})"
    none = "CAST(array() AS array<struct<start: int, end: int, value: string>>)"
    part = f"""aggregate(slice(z, 1 + {CHUNK} * k, {CHUNK}), named_struct('at', acc.at, 'out', {none}),
        (own, x) -> CASE WHEN x.`1` IS NULL THEN own ELSE named_struct(
            'at', own.at + x.`0` + length(x.`1`),
            'out', concat(own.out, array(named_struct('start', own.at + x.`0`, 'end', own.at + x.`0` + length(x.`1`), 'value', x.`2`)))) END)"""
    return F.expr(
        f"""CASE WHEN {text} RLIKE {p} THEN
        element_at(transform(array(arrays_zip(transform(split({text}, {p}, -1), x -> length(x)), regexp_extract_all({text}, {p}, 0), {value})), z ->
            aggregate(sequence(0, (size(z) - 1) DIV {CHUNK}),
                named_struct('at', 0, 'out', CAST(array() AS array<array<struct<start: int, end: int, value: string>>>)),
                (acc, k) -> element_at(transform(array({part}), own -> named_struct('at', own.at, 'out', concat(acc.out, array(own.out)))), 1),
                acc -> flatten(acc.out))), 1)
        ELSE {none} END"""
    )


def upper_tail(z: str) -> str:
    """SQL for the normal distribution's upper tail (a published Chebyshev fit of erfc, relative error below 2e-7)."""
    # Coefficients of the fit, constant term first.
    coefficients = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    x = f"(abs({z}) / sqrt(2D))"
    t = f"(1D / (1D + 0.5D * {x}))"
    poly = f"{coefficients[-1]}D"
    for c in reversed(coefficients[:-1]):
        poly = f"({c}D + {t} * {poly})"
    tail = f"(0.5D * {t} * exp(-{x} * {x} + {poly}))"
    return f"(CASE WHEN {z} >= 0 THEN {tail} ELSE 1D - {tail} END)"


def _by_encoding(values: list[str]) -> str:
    """SQL: the value of a token's encoding, by its name."""
    return "CASE c.encoding " + " ".join(f"WHEN '{e[0]}' THEN {v}" for e, v in zip(ENCODINGS, values, strict=True)) + " END"


def random_tests(n: str, k: str, squares: str, changes: str, q: str, serial: str) -> dict[str, str]:
    """SQL: standard scores of the three tests where a token of ``n`` symbols is random.

    ``squares`` adds up the squared counts of its symbols, ``changes`` counts
    neighbours of which one is of a class of symbols and the other isn't (``q``
    of all neighbours where symbols are random), ``serial`` is the correlation
    of neighbours.
    """
    return {
        "uniform": f"({k} / {n} * {squares} - {n} - ({k} - 1)) / sqrt(2 * ({k} - 1) * ({n} - 1) / {n})",
        "run": f"({changes} - ({n} - 1) * {q}) / sqrt(({n} - 1) * {q} * (1 - {q}) + 2 * ({n} - 2) * ({q} / 2 - {q} * {q}))",
        "serial": f"({serial} + 1 / {n}) * sqrt({n})",
    }


def ordinary_score(n: str, squares: str, changes: str, mixes: str, model: tuple) -> str:
    """SQL: one standard score where a token is ordinary.

    Low if its symbols are too evenly used, its neighbours too rarely differ
    (``changes``), or digits mix with others too often (``mixes``).
    """
    _, change, mix, equal, triple = model
    pairs = f"({n} * ({n} - 1) / 2)"
    parts = [f"(({squares} - {n}) / 2 + 0.5D - {pairs} * {equal}D) / sqrt({pairs} * {equal * (1 - equal)!r}D + {pairs} * ({n} - 2) * {2 * (triple - equal * equal)!r}D)"]
    if change is not None:
        parts.append(f"({changes} + 0.5D - ({n} - 1) * {change}D) / sqrt(({n} - 1) * {change * (1 - change)!r}D)")
    if mix is not None:
        parts.append(f"-({mixes} - 0.5D - ({n} - 1) * {mix}D) / sqrt(({n} - 1) * {mix * (1 - mix)!r}D)")
    return f"({' + '.join(f'({x})' for x in parts)}) / sqrt({len(parts)}D)"


def battery(candidates: str = "candidates") -> list[tuple[str, Column]]:
    """Successive columns that turn token places into array<struct<start, end, encoding, size, p>>.

    ``p`` is the p-value of "ordinary", and 1 where the token is not random either.
    """
    encoding = "CASE " + " ".join(f"WHEN c.value RLIKE {_quoted(e[1])} THEN '{e[0]}'" for e in ENCODINGS) + " END"
    shares = [sum(x in e[3][0] for x in e[2]) / len(e[2]) for e in ENCODINGS]
    q = _by_encoding([f"{2 * x * (1 - x)!r}D" for x in shares])
    tests = random_tests("c.n", "c.k", "c.squares", "c.changes", "c.q", "c.serial")
    held = lambda x: f"least(greatest({x}, -35D), 35D)"
    score = _by_encoding([ordinary_score("c.n", "c.squares", "c.changes", "c.mixes", e[3]) for e in ENCODINGS])
    return [
        (candidates, F.expr(f"filter(transform({candidates}, c -> named_struct('start', c.start, 'end', c.end, 'value', c.value, 'encoding', {encoding})), c -> c.encoding IS NOT NULL)")),
        (candidates, F.expr(f"transform({candidates}, c -> named_struct('start', c.start, 'end', c.end, 'encoding', c.encoding, 'alphabet', {_by_encoding([_quoted(e[2]) for e in ENCODINGS])}, 'class', {_by_encoding([_quoted(e[3][0]) for e in ENCODINGS])}, 'symbols', split(c.value, '')))")),
        (candidates, F.expr(f"transform({candidates}, c -> named_struct('start', c.start, 'end', c.end, 'encoding', c.encoding, 'k', CAST(length(c.alphabet) AS double), 'v', transform(c.symbols, s -> instr(c.alphabet, s) - 1), 'u', transform(c.symbols, s -> instr(c.class, s) > 0), 'd', transform(c.symbols, s -> instr('{DIGITS}', s) > 0)))")),
        (
            candidates,
            F.expr(f"""transform({candidates}, c -> named_struct('start', c.start, 'end', c.end, 'encoding', c.encoding, 'k', c.k, 'n', CAST(size(c.v) AS double), 'v', c.v,
                'squares', aggregate(array_distinct(c.v), 0D, (a, u) -> a + power(size(filter(c.v, y -> y = u)), 2)),
                'changes', CAST(size(filter(sequence(1, size(c.u) - 1), i -> c.u[i] != c.u[i - 1])) AS double),
                'mixes', CAST(size(filter(sequence(1, size(c.d) - 1), i -> c.d[i] != c.d[i - 1])) AS double),
                'mean', aggregate(c.v, 0D, (a, y) -> a + y) / size(c.v)))"""),
        ),
        (
            candidates,
            F.expr(f"""transform({candidates}, c -> named_struct('start', c.start, 'end', c.end, 'encoding', c.encoding, 'k', c.k, 'n', c.n, 'squares', c.squares, 'changes', c.changes, 'mixes', c.mixes, 'q', {q},
                'serial', CASE WHEN c.squares = c.n * c.n THEN 1D ELSE aggregate(sequence(1, size(c.v) - 1), 0D, (a, i) -> a + (c.v[i] - c.mean) * (c.v[i - 1] - c.mean))
                    / aggregate(c.v, 0D, (a, y) -> a + (y - c.mean) * (y - c.mean)) END))"""),
        ),
        (candidates, F.expr(f"transform({candidates}, c -> named_struct('start', c.start, 'end', c.end, 'encoding', c.encoding, 'n', c.n, {', '.join(f"'{x}', {held(z)}" for x, z in tests.items())}, 'ordinary', {held(score)}))")),
        (
            candidates,
            F.expr(f"""transform({candidates}, c -> named_struct('start', c.start, 'end', c.end, 'encoding', c.encoding, 'size', CAST(floor(log2(c.n)) AS int),
                'random', array(c.uniform, abs(c.run), abs(c.serial)), 'ordinary', -c.ordinary))"""),
        ),
        (candidates, F.expr(f"transform({candidates}, c -> named_struct('start', c.start, 'end', c.end, 'encoding', c.encoding, 'size', c.size, 'random', transform(c.random, (z, i) -> CASE WHEN i = 0 THEN 3 ELSE 6 END * {upper_tail('z')}), 'p', {upper_tail('c.ordinary')}))")),
        (candidates, F.expr(f"transform({candidates}, c -> named_struct('start', c.start, 'end', c.end, 'encoding', c.encoding, 'size', c.size, 'p', CASE WHEN array_min(c.random) < {RANDOM_LEAST}D THEN 1D ELSE greatest(1e-300D, c.p) END))")),
    ]


def scanned(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns with the base spans and the scored tokens of each whole text."""
    out = docs.select(*keep, text_of().alias("scan_text"))
    out = out.withColumns({"assign": places("scan_text", ASSIGN, 2), "access": places("scan_text", ACCESS), "hex": places("scan_text", HEX), "candidates": places("scan_text", TOKEN)})
    for name, column in battery():
        out = out.withColumn(name, column)
    out = out.withColumn("assign", F.filter("assign", lambda x: F.length(x["value"]) >= ASSIGN_LEAST))
    return out.drop("scan_text")


def thresholds(scored: DataFrame, false_share: float = FALSE_SHARE) -> dict[tuple[str, int], float]:
    """By encoding and doubling of the length, the p-value up to which tokens are not ordinary (Benjamini-Hochberg).

    Works on counts in ``BINS`` bins of -ln p, each taken at its largest p-value,
    so at most encodings x 30 x ``BINS`` rows ever come together.
    """
    bins = scored.select(F.explode("candidates").alias("c")).select("c.encoding", "c.size", F.least(F.lit(BINS - 1), F.floor(-F.log("c.p") / BIN_WIDTH)).cast("int").alias("bin")).groupBy("encoding", "size", "bin").agg(F.count("*").alias("n"))
    group = Window.partitionBy("encoding", "size")
    ranked = bins.select("encoding", "size", F.exp(-F.col("bin") * BIN_WIDTH).alias("p"), F.sum("n").over(group.orderBy(F.desc("bin"))).alias("up_to"), F.sum("n").over(group).alias("m"))
    rows = ranked.where(F.col("p") <= F.col("up_to") * false_share / F.col("m")).groupBy("encoding", "size").agg(F.max("p").alias("p")).collect()
    return {(r["encoding"], r["size"]): r["p"] for r in rows}


def with_spans(scored: DataFrame, cut: dict[tuple[str, int], float]) -> DataFrame:
    """Adds ``found``: array<struct<start, kind_order, end, kind>>, sorted; the method's spans are those no base span holds."""
    limit = "CASE " + " ".join(f"WHEN c.encoding = '{e}' AND c.size = {s} THEN {p!r}D" for (e, s), p in sorted(cut.items())) + " ELSE -1D END" if cut else "-1D"
    kind = lambda name: f"transform({name}, c -> named_struct('start', c.start, 'kind_order', {KINDS.index(name)}, 'end', c.end, 'kind', '{name}'))"
    out = scored.withColumn("base", F.expr(f"array_sort(concat({kind('assign')}, {kind('access')}, {kind('hex')}))"))
    fresh = f"filter(candidates, c -> c.p <= {limit} AND NOT exists(base, b -> b.start <= c.start AND b.end >= c.end))"
    return out.withColumn("found", F.expr(f"array_sort(concat(base, transform({fresh}, c -> named_struct('start', c.start, 'kind_order', 3, 'end', c.end, 'kind', 'random'))))"))


def _joined(spans: str) -> str:
    return f"array_join(transform({spans}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row.

    Null text counts as empty and has no spans; repeated rows each get their
    row; an empty table gives none; other columns are not looked at.
    """
    scored = materialise(scanned(docs, "doc_id"), "secrets")
    out = with_spans(scored, thresholds(scored))
    count = lambda name: F.size(name).cast("long").alias(f"n_{name}")
    return out.select("doc_id", count("assign"), count("access"), count("hex"), F.expr(f"sha2({_joined('base')}, 256)").alias("base_sha256"), F.expr(_joined("found")).alias("spans"))


def redact(docs: DataFrame, mask: str = MASK) -> DataFrame:
    """``docs`` with every span of a secret replaced by ``mask`` (overlapping spans by one); all rows and columns stay.

    A column ``n_chars``, where there is one, follows the new text.
    """
    scored = materialise(scanned(docs, "doc_id"), "secrets")
    cut = thresholds(scored)
    whole = with_spans(scanned(docs.select(F.struct(*docs.columns).alias("row"), "text"), "row"), cut)
    # found is sorted by start: what lies before each span that isn't inside an earlier one, and what follows the last
    text = F.expr(
        f"""CASE WHEN size(found) = 0 THEN row.text ELSE aggregate(found, named_struct('at', 0, 'out', CAST(array() AS array<string>)),
            (acc, s) -> CASE WHEN s.start >= acc.at THEN named_struct('at', s.end, 'out', concat(acc.out, array(substring(row.text, acc.at + 1, s.start - acc.at), {_quoted(mask)})))
                ELSE named_struct('at', greatest(acc.at, s.end), 'out', acc.out) END,
            acc -> array_join(concat(acc.out, array(substring(row.text, acc.at + 1))), '')) END"""
    )
    columns = [text.alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns]
    out = whole.select(*columns)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out
