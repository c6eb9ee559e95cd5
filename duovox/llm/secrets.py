"""Secret scans in DataFrame functions: three fixed patterns, and character Markov models for strings no pattern knows.

Two first-order models, of random strings and of ordinary identifiers, give each candidate string a log-likelihood
ratio. Both are trained from labelled samples by counting character pairs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duovox.llm.common import text_or_empty

#: The patterns and the least length of what they find. A run of hex digits or of key characters is found whole
#: or not at all, so the length is part of those patterns; a short assigned value still uses up its text.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGNED = 6
KINDS = ["assign", "access", "hex", "markov"]
#: Candidates of the models: runs of 16 or more with a letter at least. Runs of digits and signs alone are numbers and rules to the models.
#: FILL, which no standard assigns, stands for what the patterns have found; a run that holds it is no candidate.
FILL = "\ue000"
CANDIDATE = rf"(?<![A-Za-z0-9+/_={FILL}-])[A-Za-z0-9+/_={FILL}-]{{16,}}+"
ORDINARY = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{8,}+"
SYMBOLS = 66
SCALE = 1000
#: Common words of code, paths and addresses, and the rows of a keyboard, for ordinary names that a corpus may lack.
CODE_WORDS = (
    "access account action admin agent archive array auth backend backup base block board body bootstrap branch browser buffer build button cache call check child class client code command "
    "common component config connection console content context controller dashboard data database date default deploy description directory dist docs document download element email error "
    "event field file filter folder framework function group handler header health helper host html http import index input install interface internal job kernel key language library link "
    "list local log login manager master message method model module node number object output package page parser password pipeline plugin port private project provider proxy query queue "
    "report repository request require resource response result role root route runtime sample schema script search security select server service session shared socket source state static "
    "status storage store string system table target task template test text theme token transform update upload user value variable version view web window worker workspace www"
).split()
KEY_ROWS = "qwertyuiopasdfghjklzxcvbnmqwertyuiop"
#: Matches whose places are summed up in one go; their lists are put together after that.
RUN = 128


def held(value: Column, body) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def matches(text: Column, pattern: str, value: int = 0) -> Column:
    """Array of (gap, hit, value): the length of the text before each match, the match, a group of it; a last gap without a match."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), hits.alias("hit"), (F.regexp_extract_all(text, F.lit(pattern), F.lit(value)) if value else hits).alias("value")
    )


def found(text: Column, pattern: str, kind: str, value: int = 0, least: int = 0) -> Column:
    """Array of (start, kind number, end, value), in code points: matches from the left that don't overlap.

    The pieces between matches and the matches themselves give the offsets, run by run of RUN matches, so that no long list is copied for each match.
    """
    span = "array<struct<start:int,kind:int,end:int,value:string>>"
    number = KINDS.index(kind)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["gap"])
        end = start + F.coalesce(F.char_length(x["hit"]), F.lit(0))
        row = F.struct(start.alias("start"), F.lit(number).alias("kind"), end.alias("end"), x["value"].alias("value"))
        keep = F.char_length(x["value"]) >= least
        return F.struct(end.alias("at"), F.when(F.coalesce(keep, F.lit(False)), F.concat(acc["out"], F.array(row))).otherwise(acc["out"]).alias("out"))

    empty = F.array().cast(span)

    def join(acc: Column, run: Column) -> Column:
        own = F.aggregate(run, F.struct(acc["at"].alias("at"), empty.alias("out")), step)
        return held(own, lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    def walk(pairs: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / RUN).cast("int")), lambda k: F.slice(pairs, k * RUN + 1, F.lit(RUN)))
        return F.aggregate(runs, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{span}>").alias("out")), join, lambda acc: F.flatten(acc["out"]))

    return F.when(F.regexp_like(text, F.lit(pattern)), held(matches(text, pattern, value), walk)).otherwise(empty)


def filled(text: Column, pattern: str, value: int = 0, keep=None) -> Column:
    """text with FILL for each character of the matches that keep(value) holds for (of all, without keep)."""

    def piece(x: Column) -> Column:
        hole = F.repeat(F.lit(FILL), F.char_length(x["hit"]))
        return F.concat(x["gap"], F.coalesce(F.when(keep(x["value"]), hole).otherwise(x["hit"]) if keep else hole, F.lit("")))

    return F.when(F.regexp_like(text, F.lit(pattern)), F.array_join(F.transform(matches(text, pattern, value), piece), "")).otherwise(text)


def without_base(text: Column) -> Column:
    """text with FILL for each character of a pattern's span; a FILL of its own becomes U+FFFD."""

    def both(a: Column, b: Column) -> Column:
        merged = F.array_join(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(y == FILL, y).otherwise(x)), "")
        return F.when(~F.contains(b, F.lit(FILL)), a).when(~F.contains(a, F.lit(FILL)), b).otherwise(merged)

    own = F.translate(text, FILL, "\ufffd")
    masks = [filled(own, ASSIGN, 2, lambda v: F.char_length(v) >= ASSIGNED), filled(own, ACCESS), filled(own, HEX)]
    return held(masks[0], lambda a: held(masks[1], lambda b: held(both(a, b), lambda ab: held(masks[2], lambda c: both(ab, c)))))


def with_base(df: DataFrame, text: str) -> DataFrame:
    """df with arrays _assign, _access and _hex of the patterns' spans."""
    t = F.col(text)
    return df.withColumns({"_assign": found(t, ASSIGN, "assign", 2, ASSIGNED), "_access": found(t, ACCESS, "access"), "_hex": found(t, HEX, "hex")})


def labelled_samples(docs: DataFrame, documents: int = 4000) -> DataFrame:
    """Strings with label 1 (random) or 0 (ordinary), from whole texts of about `documents` documents at most.

    Which documents: those whose hashed text falls in a share that is set by their number, so every run takes the same, and
    copies of one text are taken all or not at all. Random: what the patterns' keys hold there, and digests of the texts in base 64,
    letters and digits, lower case, and capitals. Ordinary: all other runs of 8 or more identifier characters that have no digit or are
    short, and names put together by rule from the texts' words and numbers: UUIDs, dates, versions, paths, numbered and compound names; and
    paths, code-like and upper-case names of common words, and rows of a keyboard.
    """
    total = docs.count()
    share = max(1, math.ceil(total / documents))
    some = docs.select(text_or_empty().alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(share)) == 0)
    hits = with_base(some, "text").select(F.explode(F.transform(F.concat("_assign", "_access"), lambda s: s["value"])).alias("string"))
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), HEX, " ")
    runs = F.filter(F.regexp_extract_all("_bare", F.lit(ORDINARY), F.lit(0)), lambda w: ~w.rlike("[0-9]") | (F.char_length(w) < 16))
    words = F.filter(F.split("_bare", "[^A-Za-z]+"), lambda w: F.char_length(w).between(3, 12))
    drawn = some.select(F.sha2("text", 256).alias("digest"), F.explode(F.array(bare)).alias("_bare")).select("digest", runs.alias("runs"), words.alias("words"))
    b64 = F.regexp_replace(F.base64(F.unhex(F.sha2("digest", 512))), "\\s", "")  # 86 characters and padding
    secret = [F.substring(b64, 1, 86), F.regexp_replace(b64, "[+/=]", ""), F.lower(F.regexp_replace(b64, "[+/=]", "")), F.substring(F.upper(b64), 1, 20)]
    made = drawn.select(F.explode(F.array(*secret)).alias("string"))
    plain = drawn.select(F.explode(F.concat("runs", F.array(*compound_names(F.col("digest"), F.col("words"))))).alias("string"))
    return hits.union(made).select("string", F.lit(1).alias("label")).union(plain.select("string", F.lit(0).alias("label")))


def compound_names(digest: Column, words: Column) -> list[Column]:
    """Ordinary names of 16 or more characters, most of them with digits, by rule from a text's words, common words of code, and numbers out of its digest; some are null."""
    number = lambda k, below: F.pmod(F.conv(F.substring(digest, 4 * k + 1, 12), 16, 10).cast("long"), F.lit(below))
    word = lambda k: F.coalesce(F.get(words, F.pmod(F.conv(F.substring(digest, 5 * k + 1, 12), 16, 10).cast("long"), F.greatest(F.size(words), F.lit(1))).cast("int")), F.lit("item"))
    known = F.split(F.lit(" ".join(CODE_WORDS)), " ")  # one literal
    code = lambda k: F.get(known, number(k, len(CODE_WORDS)).cast("int"))
    row = F.substring(F.lit(KEY_ROWS), (number(6, 10) + 1).cast("int"), F.lit(20))
    two = lambda k, below, least=1: F.lpad((number(k, below) + least).cast("string"), 2, "0")
    date = lambda sep: F.concat_ws(sep, (number(1, 60) + 1980).cast("string"), two(2, 12), two(3, 28))
    time = lambda sep: F.concat_ws(sep, two(4, 24, 0), two(5, 60, 0), two(6, 60, 0))
    return [
        F.regexp_replace(F.substring(digest, 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"),
        F.concat_ws("_", word(1), word(2), number(3, 10**10), word(4)), F.concat_ws("-", word(5), F.lpad(number(1, 10**9).cast("string"), 12, "0"), word(6)),
        F.concat(word(7), number(2, 100), F.lit("_"), number(3, 100), F.lit("-"), word(8), F.lit("-"), word(9), F.lit("-"), number(4, 10)),
        F.concat(date(""), F.lit("T"), time(""), F.lit("Z-"), word(1)), F.concat(word(2), F.lit("_"), date("-"), F.lit("-"), time("-")),
        F.concat(F.initcap(word(3)), F.initcap(word(4)), F.initcap(word(5)), number(5, 1000)), F.concat_ws("/", word(6), word(7), word(8), number(6, 100)),
        F.upper(F.concat_ws("_", word(9), word(1), word(3))), F.concat_ws("-", word(2), word(4), F.concat(F.lit("v"), number(7, 20)), number(8, 20), number(9, 200)),
        F.concat_ws("/", F.concat_ws("_", code(1), code(2)), F.concat_ws("-", code(3), code(4), code(5))), F.concat_ws("/", code(6), code(7), code(8), code(9)), F.concat(code(2), F.initcap(code(4)), F.initcap(code(6)), F.initcap(code(8))),
        F.upper(F.concat_ws("_", code(3), code(5), code(7))), F.concat_ws("-", code(1), code(9), code(4), number(2, 100)), F.concat(F.initcap(code(5)), F.initcap(code(1)), F.initcap(code(3)), F.initcap(code(8))), F.when(number(1, 8) == 0, row).otherwise(F.when(number(1, 8) == 1, F.upper(row))),
    ]


def train(samples: DataFrame) -> list[int]:
    """Log-likelihood ratios (random to ordinary, in thousandths) of character pairs, at 128 x first + second; first is 0 at the start.

    Counts are summed by pair and label on the executors; at most 128 x 128 x 2 sums come to the driver. Without samples all are 0.
    """
    at = F.explode(F.sequence(F.lit(1), F.char_length("string"))).alias("i")
    clean = samples.where("string IS NOT NULL AND string != ''").select("string", "label", at)
    code = lambda i: F.ascii(F.substring("string", i, 1))
    pair = clean.select("label", F.when(F.col("i") > 1, code(F.greatest(F.col("i") - 1, F.lit(1)))).otherwise(0).alias("a"), code(F.col("i")).alias("b"))
    counts = {(r["label"], r["a"], r["b"]): r["n"] for r in pair.where("a < 128 AND b < 128").groupBy("label", "a", "b").agg(F.count("*").alias("n")).collect()}
    total = {(label, a): sum(n for (x, y, _), n in counts.items() if (x, y) == (label, a)) for label, a in {k[:2] for k in counts}}
    out = []
    for a in range(128):
        for b in range(128):
            p = [(counts.get((k, a, b), 0) + 0.5) / (total.get((k, a), 0) + 0.5 * SYMBOLS) for k in (0, 1)]
            out.append(round(SCALE * math.log(p[1] / p[0])) if counts else 0)
    return out


def ratio(string: Column, model: list[int]) -> Column:
    """A string's log-likelihood ratio in thousandths; its characters are ASCII. One walk over the characters, so long runs cost no more than their length."""
    table = F.split(F.lit(",".join(map(str, model))), ",").cast("array<int>")  # folds into one literal
    step = lambda acc, c: F.struct((acc["sum"] + F.get(table, acc["last"] * 128 + F.ascii(c))).alias("sum"), F.ascii(c).alias("last"))
    return F.aggregate(F.split(string, ""), F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")), step, lambda acc: acc["sum"])


def with_secrets(docs: DataFrame, model: list[int], least: float = 5.0) -> DataFrame:
    """docs with _assign, _access, _hex, and _markov: candidates of a ratio of at least `least` nats that touch no pattern's span."""
    df = with_base(docs.withColumn("_text", text_or_empty()), "_text")
    some = lambda rest: F.filter(found(rest, CANDIDATE, "markov"), lambda c: likely(c["value"], model, least))
    touched = F.size("_assign") + F.size("_access") + F.size("_hex") > 0
    return df.withColumn("_markov", F.when(touched, held(without_base(F.col("_text")), some)).otherwise(some(F.translate("_text", FILL, "\ufffd"))))


def likely(value: Column, model: list[int], least: float) -> Column:
    """Whether a run has a letter, no part of a pattern's span, and a ratio of at least `least` nats."""
    return ~F.contains(value, F.lit(FILL)) & value.rlike("[A-Za-z]") & (ratio(value, model) >= int(least * SCALE))


def said(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, joined by commas."""
    name = F.array(*[F.lit(k) for k in KINDS])
    line = lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(spans), line), ",")


def model_of(docs: DataFrame, documents: int = 4000) -> list[int]:
    return train(labelled_samples(docs, documents))


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_markov of each row's whole text.

    Null texts are empty; null ids and repeated rows pass through; other columns are ignored; an empty table gives no rows. The work
    for a long text grows with its length and, beyond RUN * RUN matches, a little faster. No shuffle but for the model's counts.
    """
    slim = docs.select("doc_id", "text")
    df = with_secrets(slim, model_of(slim))
    base = F.concat("_assign", "_access", "_hex")
    n = {f"n_{k}": F.size(f"_{k}").cast("long") for k in KINDS}
    return df.select(
        "doc_id", *[n[f"n_{k}"].alias(f"n_{k}") for k in KINDS[:3]], F.sha2(said(base), 256).alias("base_sha256"),
        said(F.concat(base, F.col("_markov"))).alias("spans"), n["n_markov"].alias("n_markov"),
    )


def redacted(docs: DataFrame, mask: str = "[SECRET]", least: float = 5.0) -> DataFrame:
    """docs with every found span of text replaced by mask (spans that overlap or adjoin by one); other columns and null texts as they are.

    In a text with secrets a U+E000 of its own becomes U+FFFD.
    """
    names = docs.columns
    model = model_of(docs.select("doc_id", "text"))
    clean = held(without_base(text_or_empty()), lambda t: filled(t, CANDIDATE, 0, lambda v: likely(v, model, least)))
    new = held(clean, lambda t: F.when(F.contains(t, F.lit(FILL)), F.regexp_replace(t, F.lit(f"{FILL}+"), F.lit(mask))).otherwise(F.col("text")))
    wanted = F.regexp_like("text", F.lit(ASSIGN)) | F.regexp_like("text", F.lit(ACCESS)) | F.regexp_like("text", F.lit(HEX)) | F.regexp_like("text", F.lit(CANDIDATE))
    return docs.withColumn("text", F.when(wanted, new).otherwise(F.col("text"))).select(*names)
