"""Secret scan: fixed patterns, and a randomness test battery with false-discovery control.

Everything is a DataFrame expression within a row: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brevia.llm.common import table

#: kind -> (pattern, group whose length counts, least length). Order is the order of kinds in results.
PATTERNS = {
    "assign": (
        "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
        r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    # Runs are maximal, so asking for their length in the pattern is the same as dropping the short ones after.
    "access": ("AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": ("(?<![0-9a-f])[0-9a-f]{24,}", 0, 24),
}
#: Every access or hex hit, and every candidate for the tests, has a run of so many token characters.
_SHORTEST = 20
_TOKEN = "A-Za-z0-9+/_-"

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Inferred encodings, narrowest first: name -> (test, alphabet, chance that two symbols of ordinary text agree).
ENCODINGS = {
    "decimal": ("^[0-9]+$", _DIGITS, 0.12),
    "hex": ("^[0-9a-f]+$", _DIGITS + "abcdef", 0.11),
    "hex_upper": ("^[0-9A-F]+$", _DIGITS + "ABCDEF", 0.11),
    "lower": ("^[a-z]+$", _LOWER, 0.066),
    "upper": ("^[A-Z]+$", _UPPER, 0.066),
    "base32": ("^[A-Z2-7]+=*$", _UPPER + "234567", 0.066),
    "alnum": ("^[A-Za-z0-9]+$", _UPPER + _LOWER + _DIGITS, 0.06),
    "base64url": ("^[A-Za-z0-9_-]+=*$", _UPPER + _LOWER + _DIGITS + "-_", 0.06),
    "base64": ("^[A-Za-z0-9+/_-]+=*$", _UPPER + _LOWER + _DIGITS + "+/-_", 0.06),
}
_CHUNK = 64


def _running(gaps: Column) -> Column:
    """(start, end) of each hit from (gap before it, its length), in chunks so that copies of the growing array stay few."""
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        span = F.struct(start.alias("start"), (start + x["len"]).alias("end"))
        return F.struct((start + x["len"]).alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    def chunk(acc: Column, first: Column) -> Column:
        part = F.aggregate(F.slice(gaps, first, F.lit(_CHUNK)), F.struct(acc["at"].alias("at"), empty.alias("out")), step)
        return F.struct(part["at"].alias("at"), F.concat(acc["out"], part["out"]).alias("out"))

    starts = F.sequence(F.lit(1), F.greatest(F.size(gaps), F.lit(1)), F.lit(_CHUNK))
    return F.aggregate(starts, F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("out")), chunk)["out"]


def _once(d: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are used again and again, each evaluated once.

    A generator of one row keeps the optimiser from copying an expression into every one that uses it.
    """
    return d.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def _gaps(text: Column, hits: Column, pattern: str) -> Column:
    pieces = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits))
    return F.zip_with(pieces, hits, lambda p, h: F.struct(F.char_length(p).cast("bigint").alias("gap"), F.char_length(h).cast("bigint").alias("len")))


def _phi(z: Column) -> Column:
    """Normal distribution function by a logistic approximation (error below 0.0002)."""
    z = F.greatest(F.least(z, F.lit(12.0)), F.lit(-12.0))
    return 1 / (1 + F.exp(-1.5976 * z - 0.07056 * z * z * z))


def _two_sided(z: Column) -> Column:
    return 2 * _phi(-F.abs(z))


def _inferred(span: Column, token: Column) -> Column:
    """A candidate with its encoding: the first whose test the token passes."""
    name, alphabet, agree = (None, None, None)
    for key, (test, letters, chance) in ENCODINGS.items():
        fits = token.rlike(test)
        name, alphabet, agree = [F.when(fits, v) if c is None else c.when(fits, v) for c, v in ((name, F.lit(key)), (alphabet, F.lit(letters)), (agree, F.lit(chance)))]
    size = F.char_length(alphabet).cast("double")
    return F.struct(span["start"].alias("start"), span["end"].alias("end"), name.alias("encoding"), alphabet.alias("alphabet"), size.alias("k"), agree.alias("agree"), F.regexp_replace(token, "=+$", "").alias("body"))


def _with_length(s: Column, v: Column) -> Column:
    return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.char_length(v).alias("n"))


def _span(x: Column, kind: str, encoding: Column, p_random: Column, p_ordinary: Column) -> Column:
    order = [*PATTERNS, "random"].index(kind)
    return F.struct(
        x["start"].alias("start"), F.lit(order).alias("order"), x["end"].alias("end"), F.lit(kind).alias("kind"),
        encoding.alias("encoding"), p_random.alias("p_random"), p_ordinary.alias("p_ordinary"),
    )


def _as_span(kind: str):
    none = F.lit(None).cast("double")
    return lambda x: _span(x, kind, F.lit(None).cast("string"), none, none)


def _tests(x: Column) -> Column:
    """p-values of the three tests on one candidate with its inferred encoding."""
    body, k = x["body"], x["k"]
    n = F.char_length(body).cast("double")
    chars = F.filter(F.split(body, ""), lambda c: c != "")
    codes = F.transform(chars, lambda c: F.call_function("instr", x["alphabet"], c).cast("double"))
    squares = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a + F.pow(n - F.char_length(F.replace(body, c, F.lit(""))), F.lit(2.0)))
    chi = squares * k / n - n
    return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["encoding"].alias("encoding"), n.alias("n"), k.alias("k"), x["agree"].alias("agree"), chi.alias("chi"), codes.alias("codes"))


def _values(x: Column) -> Column:
    n, k, chi, codes = x["n"], x["k"], x["chi"], x["codes"]
    z_chi = (chi - (k - 1)) / F.sqrt(2 * (k - 1) * (1 - 1 / n))
    high = F.aggregate(codes, F.lit(0.0), lambda a, c: a + (c > (k + 1) / 2).cast("double"))
    pairs = F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    runs = 1 + F.aggregate(pairs, F.lit(0.0), lambda a, p: a + ((p["a"] > (k + 1) / 2) != (p["b"] > (k + 1) / 2)).cast("double"))
    both = 2 * high * (n - high)
    var = both * (both - n) / (n * n * (n - 1))
    z_runs = F.when(var > 0, (runs - 1 - both / n) / F.sqrt(var)).otherwise(F.lit(9.0))
    mean = F.aggregate(codes, F.lit(0.0), lambda a, c: a + c) / n
    spread = F.aggregate(codes, F.lit(0.0), lambda a, c: a + (c - mean) * (c - mean))
    lagged = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + (p["a"] - mean) * (p["b"] - mean))
    z_serial = F.when(spread > 0, (lagged / spread + 1 / n) * F.sqrt(n)).otherwise(F.lit(9.0))
    fisher = -F.log(F.greatest(_phi(-z_chi), F.lit(1e-12))) - F.log(F.greatest(_two_sided(z_runs), F.lit(1e-12))) - F.log(F.greatest(_two_sided(z_serial), F.lit(1e-12)))
    excess = n * (k * x["agree"] - 1)
    p_ordinary = _phi((chi - (k - 1) - excess) / F.sqrt(2 * (k - 1) + 4 * excess))
    return F.struct(
        x["start"].alias("start"), x["end"].alias("end"), x["encoding"].alias("encoding"),
        (F.exp(-fisher) * (1 + fisher + fisher * fisher / 2)).alias("p_random"), p_ordinary.alias("p_ordinary"),
    )


def secret_scan(docs: DataFrame, text_col: str = "text", min_length: int = 20, alpha: float = 0.001, fdr: float = 0.05, out: str = "secrets") -> DataFrame:
    """Add column ``out``: array of (kind, start, end, encoding, p_random, p_ordinary), sorted by start, then kind.

    Kinds ``assign``, ``access`` and ``hex`` are the leftmost non-overlapping matches of fixed patterns
    that are long enough. Kind ``random`` is added by the method. Each run of at least ``min_length``
    token characters gets an encoding, the narrowest alphabet that holds it, and three tests against a
    uniform source over that alphabet: chi-squared on symbol counts, runs above and below the alphabet's
    middle, and lag-one serial correlation. Fisher's combination gives ``p_random``; below ``alpha`` the
    run isn't random. A run that passes is still judged against ordinary text: ``p_ordinary`` is the
    chance that text whose symbols agree as ordinary text's do looks as even at that length, so short runs,
    which can look even by chance, need more. Over the candidates of one document the Benjamini-Hochberg
    procedure at level ``fdr`` chooses those reported. Random spans within a fixed pattern's span are left out.

    Positions are code points, ends exclusive. A null or empty text has no secrets. Rows aren't changed
    otherwise, repeated rows are judged alike, and other columns may have any names.
    """
    # the row travels as one column, so that no name of its columns can clash with those added on the way
    d = docs.select(F.struct("*").alias("__row"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    empty = F.array().cast("array<string>")
    text = F.col("__text")
    # Most texts have neither a long enough run nor a sign, and cost this one pass.
    run = text.rlike(f"(?<![{_TOKEN}])[{_TOKEN}]{{{min(_SHORTEST, min_length)}}}")
    d = _once(d, __long=run, __sign=text.contains(":") | text.contains("="))
    token = f"(?<![{_TOKEN}])[{_TOKEN}]{{{min_length},}}+=*"
    patterns = {**{k: v[0] for k, v in PATTERNS.items()}, "random": token}
    hits = lambda kind, group: F.when(F.col("__sign" if kind == "assign" else "__long"), F.regexp_extract_all("__text", F.lit(patterns[kind]), F.lit(group))).otherwise(empty)
    d = _once(d, **{f"__h_{k}": hits(k, 0) for k in patterns}, **{f"__v_{k}": hits(k, v[1]) for k, v in PATTERNS.items()})
    none = F.array().cast("array<struct<gap:bigint,len:bigint>>")
    d = _once(d, **{f"__g_{k}": F.when(F.size(f"__h_{k}") > 0, _gaps(text, F.col(f"__h_{k}"), p)).otherwise(none) for k, p in patterns.items()})
    d = _once(d, **{f"__s_{k}": _running(F.col(f"__g_{k}")) for k in patterns})
    for kind, (_, _, least) in PATTERNS.items():
        d = d.withColumn(f"__s_{kind}", F.filter(F.zip_with(f"__s_{kind}", f"__v_{kind}", _with_length), lambda x: x["n"] >= least))
        d = d.withColumn(f"__s_{kind}", F.transform(f"__s_{kind}", _as_span(kind)))
    d = _once(d, __base=F.array_sort(F.concat(*[f"__s_{k}" for k in PATTERNS])))
    candidates = F.zip_with("__s_random", "__h_random", _inferred)
    fresh = F.filter(candidates, lambda x: ~F.exists("__base", lambda b: (b["start"] <= x["start"]) & (b["end"] >= x["end"])))
    d = _once(d, __c=F.transform(fresh, _tests))
    d = _once(d, __c2=F.transform("__c", _values)).drop("__c").withColumnRenamed("__c2", "__c")
    d = _once(d, __p=F.array_sort(F.transform("__c", lambda x: x["p_ordinary"])))
    steps = F.transform("__p", lambda p, i: F.when(p <= fdr * (i + 1) / F.size("__p"), p))
    d = _once(d, __cut=F.array_max(F.concat(steps, F.array(F.lit(-1.0)))))
    chosen = F.filter("__c", lambda x: (x["p_ordinary"] <= F.col("__cut")) & (x["p_random"] >= alpha))
    found = F.transform(chosen, lambda x: _span(x, "random", x["encoding"], x["p_random"], x["p_ordinary"]))
    every = F.array_sort(F.concat("__base", found))
    result = F.transform(every, lambda x: F.struct(*[x[f].alias(f) for f in ("kind", "start", "end", "encoding", "p_random", "p_ordinary")]))
    return d.select("__row.*", result.alias(out))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", **options) -> DataFrame:
    """Replace each span that ``secret_scan`` reports in ``text_col`` by ``mark``; overlapping spans become one mark.

    Texts without secrets, nulls among them, stay as they are; rows, columns and their order stay too.
    """
    d = secret_scan(docs.select(F.struct("*").alias("__row"), F.col(text_col).alias("__t")), "__t", out="__secrets", **options)
    text, zero = F.col("__t"), F.lit(0).cast("bigint")
    init = F.struct(zero.alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substr(text, (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int"))
        fresh = F.struct(x["end"].alias("at"), F.concat(acc["out"], F.array(gap, F.lit(mark))).alias("out"))
        return F.when(x["start"] >= acc["at"], fresh).otherwise(F.struct(F.greatest(acc["at"], x["end"]).alias("at"), acc["out"].alias("out")))

    done = F.aggregate("__secrets", init, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(text, (acc["at"] + 1).cast("int"))))
    d = d.withColumn("__t", F.when(F.size("__secrets") > 0, done).otherwise(text))
    return d.select(*[F.col("__t").alias(c) if c == text_col else F.col("__row")[c].alias(c) for c in docs.columns])


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of each row, repeated ones and null ids too; a null text is empty and holds nothing."""
    d = secret_scan(table(spark, sf_dir, "documents").select("doc_id", "text"), out="__s").select("doc_id", "__s")
    n = lambda kind: F.size(F.filter("__s", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return d.select(
        "doc_id", n("assign"), n("access"), n("hex"),
        F.sha2(joined(F.filter("__s", lambda x: x["kind"] != "random")), 256).alias("base_sha256"),
        joined(F.col("__s")).alias("spans"), n("random"),
    )
