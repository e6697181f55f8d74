"""Secrets in texts: candidates by shape, then a random forest that removes false positives.

A candidate is a run of at least 12 letters, digits, `+ / _ -` (with `=` padding) that holds a
digit and a letter; a key in a provider's shape; a token of parts joined by dots whose last part is
long; or whatever is assigned to a name with a secret word in it, quoted or up to the next space, of
any length and characters. A name that is assigned to is no candidate itself. The forest sees its length, how its characters change from one to the next, how much
of it a dictionary covers, the path of the text, and the words on both sides. It is trained on
labelled findings; `labelled_findings` makes a table of them of a given size.

All work is DataFrame expressions and Spark ML; no Python runs on executors. Candidates are few
and travel without their texts.

Defined results for odd input: a NULL or empty text has no candidates; a NULL path is empty;
repeated rows have the same findings each; an empty table gives an empty result; a candidate
that occurs several times in a text is one finding per occurrence; redaction replaces every
occurrence of a secret in that text that is not part of a longer word. Further columns are kept by `redact` and not looked at.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.tables import at_most, settle
from docketry.llm.url_filter import entropy

RUN = "[A-Za-z0-9+/_-]"
PLACEHOLDER = "[SECRET]"
#: letter pairs that are common in words
PAIRS = "th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|ed|is|it|al|ar|st|to|nt|ng|se|ha|ou|io|le|ve|co|me|de|ro|ri|ic|ne"
DICTIONARY = (
    "account|address|admin|agent|alpha|android|api|app|asset|auth|author|backup|base|beta|block|book|build|button|cache|"
    "channel|chapter|class|client|code|color|column|commit|component|config|content|count|data|date|default|demo|detail|"
    "device|docs|document|domain|download|edit|email|entry|error|event|example|export|field|figure|file|final|folder|font|"
    "footer|form|frame|group|handler|header|height|home|host|html|icon|image|import|index|info|input|item|java|job|json|"
    "label|language|layout|level|library|license|line|link|list|local|login|mail|main|manager|master|menu|message|method|"
    "minute|mobile|model|module|month|name|node|note|number|object|option|order|output|package|page|panel|param|part|patch|"
    "path|photo|plugin|post|product|profile|project|public|query|record|release|report|request|response|result|sample|"
    "script|search|section|server|service|session|setting|source|stage|start|state|static|status|step|store|string|style|"
    "summary|system|table|target|task|template|test|text|theme|thread|title|tool|type|update|upload|user|util|value|"
    "version|video|view|volume|week|widget|width|window|worker|year")
SECRET_WORDS = "passw|passphrase|pwd|secret|token|api.?key|apikey|access.?key|private.?key|credential|auth|bearer"
PLAIN_WORDS = (
    "commit|sha1|sha256|md5|checksum|digest|hash|revision|uuid|guid|isbn|etag|integrity|build|version|image|png|session.?id|"
    "request.?id|trace|serial|order|invoice|article|figure|chapter")
PLAIN_PATHS = r"(^|[/._-])(test|tests|example|examples|fixture|fixtures|mock|sample|vendor|lock|min|dist)([/._-]|$)"
PROVIDERS = (
    r"^(AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_[A-Za-z0-9]{36}$|^sk_(live|test)_[A-Za-z0-9]{16,}$|^xox[abprs]-[A-Za-z0-9-]{20,}$"
    r"|^AIza[A-Za-z0-9_-]{35}$|^glpat-[A-Za-z0-9_-]{20}$|^npm_[A-Za-z0-9]{36}$"
    r"|^eyJ[A-Za-z0-9_-]+(\.[A-Za-z0-9_-]+)+$|^SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}$")
#: a name with a secret word and what assigns to it, up to the value; the value itself, by its quote or up to a space
KEY = (
    rf"(?:(?i:passw|passphrase|pwd|secret|token|api.?key|apikey|access.?key|private.?key|credential|auth(?!or)|bearer)"
    r"[A-Za-z0-9_-]{0,12}(?:[\"'`]?\s{0,3}(?:=>|:=|[:=]|\bis\s)\s{0,3}[\"'`]?|\s{0,3}[\"'`])|(?i:bearer)\s{1,3})")
VALUE = (
    r"(?:(?<=\")[^\"\r\n]++(?=\")|(?<=')[^'\r\n]++(?=')|(?<=`)[^`\r\n]++(?=`)"
    r"|[^\s\"'`=:>][^\s\"'`]*(?<![.,;:)\]}>]))")
#: a key of a provider, a dotted token, or a run with a digit and a letter; no name that is assigned to
SHAPE = (
    rf"(?:(?<!{RUN})(?:(?:AKIA|ASIA)[0-9A-Z]{{16}}|gh[pousr]_[A-Za-z0-9]{{36}}|sk_(?:live|test)_[A-Za-z0-9]{{16,}}"
    r"|xox[abprs]-[A-Za-z0-9-]{20,}|AIza[A-Za-z0-9_-]{35}|glpat-[A-Za-z0-9_-]{20}|npm_[A-Za-z0-9]{36})"
    rf"(?!{RUN})|(?<!{RUN})[A-Za-z0-9_-]{{2,}}+(?:\.[A-Za-z0-9_-]{{6,}}+){{0,100}}\.[A-Za-z0-9_-]{{16,}}+(?!{RUN})"
    rf"|(?<!{RUN})(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])(?!{RUN}{{0,60}}?{KEY}{VALUE}){RUN}{{12,}}+={{0,2}})")
CANDIDATE = rf"(?:{KEY}{VALUE}|{SHAPE})"
#: the text up to a candidate or to the end, and the candidate; these pieces make up the whole text.
#: The empty group tells whether a key was read, since only then the value may be of any form.
IN_PLACE = rf"([\s\S]*?(?:{KEY}()(?={VALUE})|(?={SHAPE})|\z))((?:\2{VALUE}|{SHAPE})?)"
FEATURES = (
    "length", "digit_share", "upper_share", "entropy", "changes", "common_pairs", "dictionary", "hex", "uuid", "provider",
    "slashes", "plain_path", "word_before", "assigned", "plain_before", "word_behind", "quoted")


def findings(docs: DataFrame, path_column: str = "source") -> DataFrame:
    """doc_id, text_id, path, candidate, before, behind: one row per candidate in a text.

    text_id is a hash of the text; with the doc_id it says which row the finding is from.
    """
    shaped = docs.select(
        "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_id"),
        F.coalesce(F.col(path_column), F.lit("")).alias("path"), "text").filter(F.col("text").rlike(CANDIDATE))
    gaps, found = (F.regexp_extract_all("text", F.lit(IN_PLACE), F.lit(k)) for k in (1, 3))
    placed = shaped.select("doc_id", "text_id", "path", gaps.alias("gaps"), found.alias("found")).withColumn(
        "pieces", F.zip_with("gaps", "found", lambda a, b: F.concat(a, b)))

    def around(c: Column, k: Column) -> Column:
        # every piece up to a candidate has one character at least, so 40 of them hold 40 characters
        before = F.concat(F.array_join(F.slice("pieces", F.greatest(k - 39, F.lit(1)), F.least(k, F.lit(40))), ""),
                          F.get("gaps", k))
        behind = F.array_join(F.slice("pieces", k + 2, F.lit(20)), "")
        return F.struct(c.alias("candidate"), F.right(before, F.lit(40)).alias("before"), F.left(behind, F.lit(20)).alias("behind"))

    return placed.select("doc_id", "text_id", "path", F.explode(F.transform("found", around)).alias("f")).filter(
        "f.candidate != ''").select("doc_id", "text_id", "path", "f.candidate", "f.before", "f.behind")


def described(rows: DataFrame) -> DataFrame:
    """rows with the features of their candidates."""
    c, before, behind = F.col("candidate"), F.lower("before"), F.lower("behind")
    n = F.greatest(F.length(c), F.lit(1))

    def count(text: Column, pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern)).cast("double")

    def flag(condition: Column) -> Column:
        return F.coalesce(condition, F.lit(False)).cast("double")

    low = F.lower(c)
    return rows.withColumns({
        "length": F.length(c).cast("double"),
        "digit_share": count(c, "[0-9]") / n,
        "upper_share": count(c, "[A-Z]") / n,
        "entropy": entropy(c),
        "changes": count(c, "[a-z](?=[0-9A-Z])|[0-9](?=[a-zA-Z])|[A-Z](?=[0-9a-z])") / n,
        "common_pairs": count(low, PAIRS) / n,
        "dictionary": (F.length(c) - F.length(F.regexp_replace(low, DICTIONARY, ""))) / n,
        "hex": flag(low.rlike("^[0-9a-f]+$")),
        "uuid": flag(low.rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")),
        "provider": flag(c.rlike(PROVIDERS)),
        "slashes": count(c, "/"),
        "plain_path": flag(F.lower("path").rlike(PLAIN_PATHS)),
        "word_before": flag(before.rlike(SECRET_WORDS)),
        "assigned": flag(before.rlike(rf"({SECRET_WORDS})[a-z0-9_]{{0,12}}[\"']?\s{{0,3}}(:|=|:=|=>|is)?\s{{0,3}}[\"'`]?$")),
        "plain_before": flag(before.rlike(rf"({PLAIN_WORDS})[^a-z]{{0,6}}$")),
        "word_behind": flag(behind.rlike(SECRET_WORDS)),
        "quoted": flag(before.rlike("[\"'`]$")),
    })


def labelled_findings(spark: SparkSession, rows: int = 6000, seed: int = 1) -> DataFrame:
    """candidate, before, behind, path, label: `rows` findings, half of them secrets.

    Made by rule from numbered hashes: keys of known providers and values assigned to secret
    names on one side; commit ids, checksums, identifiers, file names and page names on the other.
    """
    number = F.col("id")
    digest = F.sha2(F.concat(F.lit(f"{seed}-"), number.cast("string")), 256)
    more = F.sha2(F.concat(digest, F.lit("+")), 512)
    pick = F.pmod(F.xxhash64(digest, F.lit(3)), F.lit(1000)).cast("int")

    def one_of(options: list[str], salt: int) -> Column:
        return F.element_at(F.array(*map(F.lit, options)), (F.pmod(F.xxhash64(digest, F.lit(salt)), F.lit(len(options))) + 1).cast("int"))

    base64 = F.regexp_replace(F.base64(F.unhex(F.substring(more, 1, 96))), "[+/=\\s]", "")
    upper = F.translate(F.upper(F.substring(more, 1, 60)), "0123456789ABCDEF", "QWERTYUIOP23456KLZXCVBNM"[:16])
    size = F.lit(14) + F.pmod(F.xxhash64(digest, F.lit(5)), F.lit(30)).cast("int")
    name = one_of(["password", "passwd", "secret", "token", "api_key", "apiKey", "access_key", "client_secret", "auth_token", "db_password"], 7)
    join = one_of(["=", " = ", ": ", '="', ' = "', ": '", '": "', "=>'"], 8)
    word = one_of(["the value of ", "see the ", "and then ", "with ", "from here to ", "on page ", "in the list ", "he said that "], 9)
    other = one_of(["commit ", "sha256 ", "md5: ", "checksum=", "revision ", "uuid ", "etag: ", "build ", "integrity sha512-", "image "], 10)
    slug = F.concat_ws("-", one_of(DICTIONARY.split("|"), 11), one_of(DICTIONARY.split("|"), 12), one_of(DICTIONARY.split("|"), 13), pick.cast("string"))
    uuid = F.regexp_replace(F.substring(digest, 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    kinds = [
        # secrets
        (F.concat(F.lit("AKIA"), F.substring(upper, 1, 16)), F.concat(word, F.lit("")), 1),
        (F.concat(F.lit("ghp_"), F.rpad(F.substring(base64, 1, 36), 36, "x7")), F.concat(word, F.lit("")), 1),
        (F.substring(digest, F.lit(1), size), F.concat(word, name, join), 1),
        (F.concat(F.lit("7"), F.substring(base64, F.lit(1), size)), F.concat(word, name, join), 1),
        (F.substring(more, 1, 40), F.concat(word, name, join), 1),
        (F.concat(F.lit("sk_live_"), F.substring(base64, 1, 24), F.lit("5")), F.concat(name, join), 1),
        (F.concat(F.initcap(one_of(DICTIONARY.split("|"), 18)), one_of(["!", ".", "@", "#", "$", "%", "~", "2"], 19), pick.cast("string")), F.concat(word, name, join), 1),
        (F.translate(F.substring(digest, F.lit(1), F.lit(8) + size % 12), "0123456789", "ghijklmnop"), F.concat(word, name, join), 1),
        (F.concat(*[one_of("correct horse battery staple river stone candle purple hunter monkey dragon winter".split(), k) for k in (20, 21, 22)]), F.concat(word, name, join), 1),
        (F.concat(one_of("hunter monkey dragon winter summer purple".split(), 23), (pick % 100).cast("string")), F.concat(word, name, join), 1),
        (F.concat(F.lit("eyJ"), F.substring(base64, 1, 17), F.lit(".eyJ"), F.substring(base64, 20, 20), F.lit("."), F.rpad(F.substring(base64, 30, 43), 43, "k3")), word, 1),
        # others
        (one_of(["string", "str", "None", "null", "true", "false", "required", "optional", "text", "value", "get_token()", "the", "a", "not", "int"], 24), F.concat(word, name, one_of([": ", " = ", "=", " is "], 25)), 0),
        (F.substring(digest, 1, 40), F.concat(word, other), 0),
        (F.substring(digest, 1, 64), F.concat(word, other), 0),
        (uuid, word, 0),
        (slug, word, 0),
        (F.replace(slug, F.lit("-"), F.lit("_")), F.concat(name, F.lit(" ")), 0),
        (F.concat(F.lit("assets/"), slug, F.lit("/"), pick.cast("string")), F.concat(word, F.lit("/")), 0),
        (F.substring(digest, F.lit(1), size), word, 0),
        (F.concat(one_of(["20240131T", "v1-2-3-rc", "ISBN978", "order-00", "fig-2024-"], 14), pick.cast("string"), F.lit("0001")), word, 0),
    ]
    which = F.when(number % 2 == 0, F.pmod(F.xxhash64(digest, F.lit(15)), F.lit(11))).otherwise(
        F.lit(11) + F.pmod(F.xxhash64(digest, F.lit(15)), F.lit(9)))
    candidate = before = label = F.lit(None)
    for k, (value, left, is_secret) in enumerate(kinds):
        candidate, before, label = (
            F.when(which == k, v).otherwise(old) for v, old in ((value, candidate), (left, before), (F.lit(is_secret), label)))
    path = one_of(["src0", "src7", "app/config.py", "docs/readme.md", "tests/fixtures/a.json", "web/main.js", "deploy.env", ""], 16)
    return spark.range(0, rows, 1, 2).select(
        candidate.alias("candidate"), before.alias("before"), one_of([" and", '"', "\n", ";", " of the", "'", ", ", ""], 17).alias("behind"),
        path.alias("path"), label.cast("double").alias("label"))


def train(labelled: DataFrame, trees: int = 24, depth: int = 8, seed: int = 5) -> PipelineModel:
    """Fit the forest on labelled findings (candidate, before, behind, path, label); a bounded table."""
    stages = [
        VectorAssembler(inputCols=list(FEATURES), outputCol="features"),
        RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed)]
    return Pipeline(stages=stages).fit(described(labelled).select("label", *FEATURES))


def scan(docs: DataFrame, model: PipelineModel, path_column: str = "source") -> DataFrame:
    """The findings of every text with the forest's score, and is_secret (score above one half)."""
    scored = model.transform(described(findings(docs, path_column)))
    score = vector_to_array("probability")[1]
    return scored.select(
        "doc_id", "text_id", "candidate", "before", score.alias("score"), (score > 0.5).alias("is_secret"))


FEW = 200_000


def redact(docs: DataFrame, found: DataFrame, placeholder: str = PLACEHOLDER) -> DataFrame:
    """docs, all columns and rows, with the secrets in their texts replaced; n_chars follows the text.

    Texts with secrets are few as a rule; their lists are broadcast up to FEW of them.
    """
    names = docs.columns
    secrets = settle(found.filter("is_secret").groupBy("doc_id", "text_id").agg(F.collect_set("candidate").alias("secrets")))
    given = docs.select(
        F.struct("*").alias("given"), "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_id"))
    # longest first, so that no secret is cut by a shorter one inside it
    ordered = F.array_sort("secrets", lambda a, b: F.coalesce(
        F.nullif(F.length(b) - F.length(a), F.lit(0)), F.when(a < b, -1).when(a > b, 1).otherwise(0)))
    side = secrets.select(F.col("doc_id").alias("of"), F.col("text_id").alias("of_text"), ordered.alias("secrets"))
    if at_most(side, FEW):
        side = F.broadcast(side)

    def whole(s: Column) -> Column:
        # a short secret may be part of other words, which stay
        quoted = F.concat(F.lit("\\Q"), F.replace(s, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
        return F.concat(F.lit("(?<![A-Za-z0-9])"), quoted, F.lit("(?:(?<![A-Za-z0-9])|(?![A-Za-z0-9]))"))

    joined = given.join(side, (F.col("doc_id").eqNullSafe(F.col("of"))) & (F.col("text_id") == F.col("of_text")), "left")
    text = F.when(F.col("secrets").isNull(), F.col("given.text")).otherwise(F.aggregate(
        "secrets", F.col("given.text"), lambda t, s: F.regexp_replace(t, whole(s), F.lit(placeholder))))
    changed = joined.withColumn("new_text", text)
    return changed.select(*[
        F.col("new_text").alias(c) if c == "text"
        else F.when(F.col("secrets").isNull(), F.col("given")[c]).otherwise(F.length("new_text").cast("long")).alias(c) if c == "n_chars"
        else F.col("given")[c].alias(c) for c in names])
