"""Secret scan: candidate strings in texts, and a random forest that removes the false ones. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A candidate: a run of the alphabets that keys are written in, of at least 16 characters, or of 8 behind an assignment;
#: equal signs belong to it only where they end it.
RUN, PADDING = "[A-Za-z0-9_+/-]", "(?:={1,2}(?![A-Za-z0-9_+/=\"'-]))?"
CANDIDATE = f"(?<!{RUN})(?:{RUN}{{16,}}+|(?<=(?:=|:|=>)\\s?[\"']?){RUN}{{8,}}+){PADDING}"
#: Candidates of a text whose places are added up together.
STEP = 256
#: Characters looked at on each side.
LEFT, RIGHT = 48, 24
TREES, DEPTH = 30, 6
THRESHOLD = 0.5

#: Words that stand beside secrets, beside other long strings, and inside long strings that are no secrets.
NEAR_SECRETS = "token|secret|passwd|password|pwd|api[_-]?key|apikey|access[_-]?key|private|credential|auth|bearer|client|signing|key"
NEAR_OTHERS = "commit|sha1|sha256|md5|checksum|hash|digest|integrity|etag|uuid|guid|build|version|order|invoice|isbn|serial|tracking|phone|session|trace|request|example|sample|dummy|placeholder|test"
DICTIONARY = "example|sample|test|dummy|demo|user|name|file|image|photo|data|config|http|https|www|index|html|page|article|version|release|build|item|order|number|title|node|class|value|table|column|field|list|model|report|draft|final|summer|winter|spring|january|march|april|june|july|august|october|your|here|change|insert|replace|xxxx|1234|0000"
PATH_HINTS = "test|example|sample|fixture|mock|doc|readme|demo"

FEATURES = ["length", "digits", "upper", "lower", "signs", "changes", "case_changes", "distinct", "hexadecimal", "repeats", "dictionary", "path_hint", "secret_left", "other_left", "assigned", "quoted", "secret_near", "closed", "vowels", "clusters"]


def share(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)) / F.greatest(F.char_length(text), F.lit(1))


def described(found: DataFrame) -> DataFrame:
    """The columns FEATURES beside candidate, left, right and path."""
    c, left, right = F.col("candidate"), F.lower("left"), F.lower("right")
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    return found.withColumns(
        {
            "length": F.least(F.char_length(c), F.lit(200)).cast("double"),
            "digits": share(c, "[0-9]"),
            "upper": share(c, "[A-Z]"),
            "lower": share(c, "[a-z]"),
            "signs": share(c, "[^A-Za-z0-9]"),
            "changes": share(c, "(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]"),
            "case_changes": share(c, "(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]"),
            "distinct": F.size(F.array_distinct(F.split(c, ""))) / F.least(F.char_length(c), F.lit(40)),
            "hexadecimal": flag(c.rlike("^[0-9a-f]+$") | c.rlike("^[0-9A-F]+$")),
            "repeats": share(c, "(.)\\1"),
            "dictionary": 1.0 - F.char_length(F.regexp_replace(F.lower(c), DICTIONARY, "")) / F.greatest(F.char_length(c), F.lit(1)),
            "path_hint": flag(F.lower("path").rlike(PATH_HINTS)),
            "secret_left": flag(left.rlike(f"(?:{NEAR_SECRETS})[a-z_]*[\"']?\\s*(?:=|:|:=|=>)?\\s*[\"']?$")),
            "other_left": flag(left.rlike(f"(?:{NEAR_OTHERS})[a-z_]*[\"']?\\s*(?:=|:|#|-)?\\s*[\"']?$")),
            "assigned": flag(left.rlike("(?:=|:|=>)\\s*[\"']?$")),
            "quoted": flag(left.rlike("[\"']$") & right.rlike("^[\"']")),
            "secret_near": flag(left.rlike(NEAR_SECRETS)),
            "closed": flag(right.rlike("^(?:[\"';,)]|\\s|$)")),
            "vowels": share(c, "[aeiouyAEIOUY]"),
            "clusters": share(F.lower(c), "[bcdfghjklmnpqrstvwxz]{4}"),
        }
    )


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body reads it."""
    return F.transform(F.array(value), body)[0]


def running(steps: Column) -> Column:
    """The running sums of an array of numbers: within blocks of STEP, behind the sums of the blocks before."""
    last = F.size(steps) - 1
    blocks = F.sequence(F.lit(0), F.floor(last / STEP).cast("int"))
    inside = lambda k: F.sequence(k * STEP, F.least(last, k * STEP + (STEP - 1)))
    begin = lambda at: F.named_struct(F.lit("at"), at, F.lit("all"), F.array().cast("array<int>"))
    grown = lambda s, x: F.named_struct(F.lit("at"), s["at"] + x, F.lit("all"), F.concat(s["all"], F.array(s["at"] + x)))
    sums = F.transform(blocks, lambda k: F.aggregate(inside(k), F.lit(0), lambda s, i: s + steps[i]))
    return bound(
        F.aggregate(sums, begin(F.lit(0)), grown)["all"],
        lambda ends: F.flatten(F.transform(blocks, lambda k: F.aggregate(inside(k), begin(F.when(k > 0, F.get(ends, k - 1)).otherwise(0)), lambda s, i: grown(s, steps[i]))["all"])),
    )


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """id, number, start (character), candidate, left, right, path: every candidate of every text.

    What stands between the candidates gives their places and surroundings; time and memory grow with the text,
    however many there are. left and right reach over one neighbouring candidate.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    path = F.lit("") if path_col is None else F.coalesce(F.col(path_col).cast("string"), F.lit(""))
    none = F.lit("")

    def surrounded(found: Column, between: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(found) - 1)
        steps = F.transform(places, lambda i: F.char_length(between[i]) + F.coalesce(F.char_length(F.get(found, i - 1)), F.lit(0)))
        ending = lambda part, i: F.right(F.coalesce(F.get(part, i), none), F.lit(LEFT))
        starting = lambda part, i: F.left(F.coalesce(F.get(part, i), none), F.lit(RIGHT))
        item = lambda i, starts: F.struct(
            i.cast("long").alias("number"), starts[i].cast("long").alias("start"), found[i].alias("candidate"),
            F.right(F.concat(ending(between, i - 1), ending(found, i - 1), ending(between, i)), F.lit(LEFT)).alias("left"),
            F.left(F.concat(starting(between, i + 1), starting(found, i + 1)), F.lit(RIGHT)).alias("right"),
        )
        return bound(steps, lambda s: bound(running(s), lambda starts: F.transform(places, lambda i: item(i, starts))))

    every = bound(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), lambda found: bound(F.split(text, CANDIDATE, -1), lambda between: surrounded(found, between)))
    found = docs.where(text.rlike(CANDIDATE)).select(F.col(id_col), path.alias("path"), F.explode_outer(every).alias("found"))
    return found.select(id_col, *[F.col("found")[name].alias(name) for name in ("number", "start", "candidate", "left", "right")], "path")


def labelled_findings(spark: SparkSession, each: int = 120) -> DataFrame:
    """Findings with labels, made by rule: the shape and the surroundings of `each` secrets or false alarms per line."""
    n = F.col("id")
    hexa = lambda k: F.substring(F.sha2(F.concat(F.lit(str(k)), n.cast("string")).cast("binary"), 256), 1, k)
    base = lambda k: F.substring(F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat(F.lit("b"), n.cast("string")).cast("binary"), 512))), "=", ""), 1, k)
    pick = lambda *words: F.element_at(F.array(*[F.lit(w) for w in words]), (F.pmod(F.xxhash64(n, F.lit(words[0])), F.lit(len(words))) + 1).cast("int"))
    prose = lambda: pick("the and of with ", "when it ran ", "elle une des ", "und die der ", "see it below. ", "")
    path = pick("src1", "app/settings.py", "mail", "src7", "deploy.env")
    tests = pick("tests/fixture.json", "docs/readme.md", "example.cfg")
    quote, end = pick('"', "'", '"'), pick(" the", ", and", " une", "")
    name = pick("token", "api_key", "secret", "password", "access_key", "auth_token", "client_secret")
    number = n.cast("string")
    letters = lambda k: F.translate(base(k), "0123456789+/", "qWxKzBvJmGhD")
    long_word = pick("internationalization", "uncharacteristically", "Verantwortlichkeit", "responsabilisation", "incomprehensibilities", "counterrevolutionary", "Geschwindigkeitsbegrenzung", "electroencephalograph")
    plain = pick("something", "everything", "Wednesday", "understanding", "Gesellschaft", "quelquefois", "background", "horizontal", "available", "therefore")
    lines = [
        (1, F.concat(prose(), name, F.lit(" = "), quote), hexa(40), F.concat(quote, end), path),
        (1, F.concat(prose(), name, F.lit(": ")), hexa(32), end, path),
        (1, F.concat(name, F.lit("="), quote), base(40), F.concat(quote, end), path),
        (1, F.concat(prose(), F.lit("Authorization: Bearer ")), base(56), end, path),
        (1, F.concat(prose(), name, F.lit(" "), quote), F.concat(F.lit("AKIA"), F.upper(hexa(16))), F.concat(quote, end), path),
        (1, F.concat(prose(), name, F.lit(" => "), quote), F.concat(F.lit("sk_live_"), base(24)), F.concat(quote, end), path),
        (1, F.concat(prose()), F.concat(F.lit("ghp_"), base(36)), end, path),
        (0, F.concat(prose(), pick("commit ", "sha1: ", "sha256: ", "checksum ", "etag ")), hexa(40), end, path),
        (0, F.concat(prose(), pick("md5 = ", "digest: ", "build ", "hash ")), hexa(32), end, path),
        (0, F.concat(prose(), pick("uuid ", "request ", "trace id ", "session ")), F.concat_ws("-", hexa(8), hexa(4), hexa(4), hexa(4), hexa(12)), end, path),
        (0, F.concat(prose(), pick("phone ", "order ", "call ", "")), F.substring(F.concat(F.lit("26"), F.regexp_replace(hexa(40), "[a-f]", "7")), 1, 16), end, path),
        (0, F.concat(name, F.lit(" = "), quote), F.concat(pick("your_token_here_", "example_key_", "xxxxxxxxxxxxxxxx", "replace_with_secret_"), number), quote, tests),
        (0, F.concat(prose(), name, F.lit(" = "), quote), hexa(40), F.concat(quote, end), tests),
        (0, prose(), F.concat(pick("release_notes_final_", "image_summer_2019_", "chapter-one-section-", "user_table_column_"), number), end, path),
        (0, prose(), F.concat(pick("www/articles/2020/01/", "data/model/version", "static/images/photo"), number), end, path),
        (1, F.concat(name, F.lit(" = "), quote), base(14), F.concat(quote, end), path),
        (1, F.concat(prose(), name, F.lit(" = ")), F.concat(letters(45), F.lit("123")), end, path),
        (1, F.concat(prose(), name, F.lit(": ")), letters(26), end, path),
        (1, F.concat(prose(), pick("key=", "access_key=", "aws_key = ")), F.concat(F.lit("AKIA"), F.upper(hexa(16))), end, path),
        (0, prose(), long_word, end, path),
        (0, F.concat(prose(), pick("as follows: ", "note: ", "Subject: ", "here: ")), F.when(F.pmod(n, F.lit(2)) == 0, plain).otherwise(long_word), end, path),
        (0, F.concat(pick("color", "title", "mode", "align", "class"), F.lit("="), quote), plain, F.concat(quote, end), path),
        (0, F.concat(prose(), pick("call ", "see ", "")), pick("getUserAccountName", "readFileContentsAsText", "is_connection_established", "max_number_of_retries", "src/main/resources/application", "state-of-the-art-methods"), end, path),
        (0, F.concat(name, F.lit(" = ")), pick("get_token_from_environment", "load_secret_value", "read_password_field", "settings_api_key_name"), pick("(", "()", "[0]"), path),
        (0, F.concat(prose(), pick("date: ", "time: ", "number: ", "total=")), F.concat(F.lit("2024"), F.lpad(number, 4, "0")), end, path),
        (0, prose(), F.concat(F.lit("0000000000000000000"), number), end, path),
    ]
    rows = [spark.range(each).select(F.lit(y).alias("label"), left.alias("left"), c.alias("candidate"), right.alias("right"), p.alias("path")) for y, left, c, right, p in lines]
    return reduce(DataFrame.union, rows)


def train(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH) -> RandomForestClassificationModel:
    """A forest over FEATURES from findings with label, candidate, left, right and path."""
    rows = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(described(labelled)).select("x", F.col("label").cast("double").alias("label"))
    return RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, seed=7).fit(rows.coalesce(1))


def scan(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", model: RandomForestClassificationModel | None = None) -> DataFrame:
    """One row per candidate: id, number, start, candidate, score, secret.

    Candidates are found in whole texts; nothing is shuffled. The forest sees
    length, kinds of characters and changes between them, coverage by common
    words, the path and the neighbouring words, and says which are secrets.

    A candidate has 16 characters or more, 8 behind an assignment; which of
    them hold letters or digits is left to the forest. Strings with other
    characters than those of RUN are not looked for.

    Null and empty texts have no candidates; a null path is no hint. Repeated
    rows give their candidates each. Candidates inside one text are numbered
    from 0 in order. Without candidates, or on an empty table, no rows come.
    """
    model = train(labelled_findings(spark)) if model is None else model
    path = F.lit("") if path_col is None else F.col(path_col)
    found = described(candidates(docs.select(F.col(id_col).alias("scanned"), F.col(text_col).alias("t"), path.alias("p")), "scanned", "t", "p"))
    scored = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="x").transform(found))
    score = vector_to_array("probability")[1]
    return scored.select(F.col("scanned").alias(id_col), "number", "start", "candidate", score.alias("score"), (score >= THRESHOLD).alias("secret"))
