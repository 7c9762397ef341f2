"""Secret scans: candidates by pattern, false positives removed by a random forest. DataFrame functions only.

Candidates are (1) values assigned to a name that holds a word such as password or token, (2) private keys up to
their END line, (3) runs of at least 16 token characters with a digit, a known key's prefix or a capital after a
small letter; other runs, of letters of one case, are taken for words. split() and regexp_extract_all() with the same pattern give the
text around the matches, so offsets and neighbours come from two passes over texts that match at all. The forest's
features are the candidate's length, character transitions, dictionary coverage, path marks and neighbouring words;
it is trained by Spark ML from labelled findings, by default a bounded set written out by a seeded generator.

Defined cases: null and empty texts have no findings; offsets count characters from 0; repeated rows give
repeated findings; equal scores need no order, as every candidate is judged alone (score >= threshold is a
secret); texts of any length are scanned whole; other columns are not read.
"""

from __future__ import annotations

import json
import random
import string

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

NAMES = "password|passwd|passphrase|pwd|secret|token|api[_-]?key|apikey|access[_-]?key|auth|credential|client[_-]?secret|private[_-]?key"
#: Runs of token characters start where none stands before; all looks ahead are possessive, so a run is read once.
RUN = "[A-Za-z0-9+/_.-]"
VALUE = r"[ \t]{0,3}[=:][ \t]{0,3}[\"']?(?!-----BEGIN )[^\s\"'`,;<>(){}|]"
ASSIGNED = rf"(?={RUN}++[\"']?{VALUE}{{8}}){RUN}*?(?i:{NAMES}){RUN}*+[\"']?{VALUE}{{8,}}"
KEY_END = r"-----END [A-Z ]{0,20}PRIVATE KEY(?: BLOCK)?-----"
#: A private key up to its END line, or, where that is missing, with the key lines that follow its header.
HEADER = rf"-----BEGIN [A-Z ]{{0,20}}PRIVATE KEY(?: BLOCK)?-----(?:[^-]*+(?:-{{1,4}}(?!-)[^-]*+)*+{KEY_END}|(?:\s{{1,4}}[A-Za-z0-9+/=]{{20,}}+)*+)"
PREFIXES = "AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|glpat-|sk-|sk_live_|rk_live_|xox[abpr]-|eyJ|AIza|SG[.]|hf_|npm_|-----BEGIN"
TOKEN = rf"(?=[A-Za-z+/_.-]*+[0-9]|(?:{PREFIXES})|{RUN}*?[a-z][A-Z]){RUN}{{16,}}={{0,2}}"
PATTERN = f"{HEADER}|(?<!{RUN})(?:{ASSIGNED}|{TOKEN})"
#: Characters of context on either side.
BEFORE, AFTER = 64, 32
THRESHOLD = 0.5
TREES, DEPTH, SEED, TRAIN_ROWS = 24, 7, 11, 2400
MARK = "[SECRET]"
ADDED = ["start", "length", "candidate", "before", "after", "kind", "score", "is_secret"]

#: Words that neighbours or candidates are made of in code and prose: fixed values.
SECRET_WORDS = "password|passwd|passphrase|pwd|secret|token|api|key|auth|bearer|credential|login|private|access"
BENIGN_WORDS = "sha|sha1|sha256|md5|commit|checksum|digest|hash|uuid|guid|isbn|serial|order|invoice|phone|tel|card|build|version|revision|example|sample|placeholder|dummy|test|etag|id"
DICTIONARY = (
    "example|sample|test|dummy|your|here|change|placeholder|value|name|user|admin|client|server|data|file|path|home|main|java|python|node|module|index|page|"
    "image|style|script|config|version|build|release|chapter|section|figure|table|report|part|item|list|order|number|date|time|year|month|week|"
    "and|the|for|with|from|this|that|tion|ing|ent|ment|ble|her|ther|tre|que|eau|elle|ung|heit|keit|sch|lich|ver|ber|ción|mente|para|aci|ado|con|est|les|des|der|die|und"
)


def candidates(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row a match: kept columns, start, length, candidate, before, after."""
    keep = C.kept(docs.columns if keep is None else keep, ADDED)
    pattern = F.lit(PATTERN)
    hit = docs.where(F.col(text).rlike(PATTERN)).select(
        *keep, F.split(F.col(text), PATTERN, -1).alias("__gaps"), F.regexp_extract_all(F.col(text), pattern, F.lit(0)).alias("__hits")
    )
    first = F.transform("__hits", lambda h, i: F.struct(h.alias("h"), F.element_at("__gaps", i + 1).alias("b"), F.element_at("__gaps", i + 2).alias("a")))
    empty = F.array().cast("array<struct<h:string,b:string,a:string,at:int>>")
    placed = F.aggregate(  # offsets: what the gaps and matches before it add up to
        first,
        F.struct(F.lit(0).alias("end"), empty.alias("out")),
        lambda s, x: F.struct(
            (s["end"] + F.length(x["b"]) + F.length(x["h"])).alias("end"),
            F.concat(s["out"], F.array(F.struct(x["h"].alias("h"), F.right(x["b"], F.lit(BEFORE)).alias("b"), F.left(x["a"], F.lit(AFTER)).alias("a"), (s["end"] + F.length(x["b"])).alias("at")))).alias("out"),
        ),
        lambda s: s["out"],
    )
    whole = F.col("m.h").startswith("-----BEGIN ") | F.col("m.h").rlike(f"^{RUN}{{16,}}={{0,2}}$")
    value = F.when(whole, F.col("m.h")).otherwise(F.regexp_extract("m.h", r"[=:][ \t]{0,3}[\"']?([^\s\"']{8,})$", 1))
    lead = F.length("m.h") - F.length("candidate")
    return (
        hit.select(*keep, F.explode(placed).alias("m"))
        .withColumn("candidate", value)
        .select(
            *keep,
            (F.col("m.at") + lead).alias("start"),
            F.length("candidate").alias("length"),
            "candidate",
            F.concat("m.b", F.substring("m.h", F.lit(1), lead)).alias("before"),
            F.col("m.a").alias("after"),
            F.when(F.col("candidate").startswith("-----BEGIN"), "private_key").when(lead > 0, "assigned").otherwise("token").alias("kind"),
        )
    )


#: Characters that candidates are made of, a control character between them.
MARKS = "\u0001".join(string.ascii_letters + string.digits + string.punctuation)


def features(found: DataFrame) -> tuple[DataFrame, list[str]]:
    c, n = F.col("candidate"), F.greatest(F.length("candidate"), F.lit(1))
    low = F.lower(c)
    letters = F.greatest(F.length(F.regexp_replace(low, r"[^\p{L}]", "")), F.lit(1))

    def share(pattern: str) -> Column:
        return F.regexp_count(c, F.lit(pattern)) / n

    made = {
        "f_length": F.log2(n.cast("double")),
        "f_digits": share("[0-9]"),
        "f_upper": share("[A-Z]"),
        "f_marks": share(r"[^A-Za-z0-9]"),
        "f_distinct": F.aggregate(F.split(F.lit(MARKS), "\u0001"), F.lit(0), lambda s, x: s + F.contains(c, x).cast("int")) / F.least(n, F.lit(64)),
        "f_letter_digit": share("(?=[A-Za-z][0-9]|[0-9][A-Za-z])"),
        "f_case": share("(?=[a-z][A-Z]|[A-Z][a-z])"),
        "f_alternate": share("(?i)(?=[aeiou][bcdfghj-np-tv-z]|[bcdfghj-np-tv-z][aeiou])"),
        "f_repeat": share(r"(?=(.)\1)"),
        "f_dictionary": 1 - F.length(F.regexp_replace(F.regexp_replace(low, r"[^\p{L}]", ""), DICTIONARY, "")) / letters,
        "f_slashes": F.regexp_count(c, F.lit(r"[/.]")).cast("double"),
        "f_path": (F.col("before").rlike(r"[/\\.~@-]$") | F.col("after").rlike(r"^[/\\]|^\.[a-z]{2,4}\b") | c.rlike(r"^[/.]|[A-Za-z_]+/[A-Za-z_.]+/")).cast("double"),
        "f_assign": F.col("before").rlike(r"[=:][ \t]*[\"']?$").cast("double"),
        "f_quoted": (F.col("before").rlike(r"[\"'`]$") & F.col("after").rlike(r"^[\"'`]")).cast("double"),
        "f_secret_word": F.col("before").rlike(rf"(?i)(?:{SECRET_WORDS})(?:[_.-][a-z0-9_.-]{{0,40}})?[^a-z]{{0,24}}$").cast("double"),
        "f_benign_word": F.col("before").rlike(rf"(?i)\b(?:{BENIGN_WORDS})\b[^a-z]{{0,12}}$").cast("double"),
        "f_hex": c.rlike("^[0-9a-fA-F]+$").cast("double"),
        "f_number": c.rlike("^[0-9._/+-]+$").cast("double"),
        "f_prefix": c.rlike(f"^(?:{PREFIXES})").cast("double"),
    }
    return found.withColumns(made), list(made)


def labelled_findings(spark: SparkSession, rows: int = TRAIN_ROWS, seed: int = SEED) -> DataFrame:
    """Labelled findings (candidate, before, after, label), as many as `rows`: written out from the seed, half of them secrets."""
    r = random.Random(seed)
    alnum, b64 = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    some = lambda alphabet, n: "".join(r.choice(alphabet) for _ in range(n))
    syllables = "the of and er in on th es re ti la de ung sch que eau ción ment ado ing".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    prose = lambda: " ".join(word() for _ in range(r.randint(2, 9)))
    out = []
    while len(out) < rows:
        name = r.choice("token secret password api_key apikey auth_token access_key client_secret passwd".split())
        quote = r.choice(['"', "'", ""])
        assign = f"{r.choice([prose(), '', 'const', 'export'])} {name}{r.choice([' = ', '=', ': '])}{quote}"
        secret = r.choice([
            lambda: some("0123456789abcdef", r.choice([32, 40, 40, 48, 64])), lambda: some(b64, r.randint(20, 64)), lambda: some(alnum, r.randint(16, 48)),
            lambda: "AKIA" + some(string.ascii_uppercase + string.digits, 16), lambda: "ghp_" + some(alnum, 36), lambda: "sk-" + some(alnum, 40),
            lambda: some(alnum + "!#$%&*", r.randint(8, 20)), lambda: "eyJ" + some(alnum, 30) + "." + some(alnum, 40) + "." + some(alnum, 40),
        ])()
        kind = r.random()
        if kind < 0.4:
            out.append((secret, assign, quote + r.choice([" ", "\n", ";", ""]) + prose(), 1))
        elif kind < 0.46:
            out.append((r.choice(["AKIA" + some(string.ascii_uppercase + string.digits, 16), "ghp_" + some(alnum, 36), "sk-" + some(alnum, 40)]), prose() + " ", " " + prose(), 1))
        elif kind < 0.48:
            owner, lines = r.choice(["", "RSA ", "EC "]), "".join("\n" + some(b64, 64) for _ in range(r.randint(0, 24)))
            out.append((f"-----BEGIN {owner}PRIVATE KEY-----" + (f"{lines}\n-----END {owner}PRIVATE KEY-----" if lines else ""), r.choice([prose() + "\n", ""]), "\n" + prose(), 1))
        elif kind < 0.53:
            out.append((some("0123456789abcdef", r.choice([32, 40, 64])), f"{prose()} {r.choice('commit sha1 sha256 md5 checksum digest etag revision'.split())} {r.choice(['', ': ', '= '])}", " " + prose(), 0))
        elif kind < 0.58:
            u = some("0123456789abcdef", 32)
            out.append((f"{u[:8]}-{u[8:12]}-{u[12:16]}-{u[16:20]}-{u[20:]}", prose() + r.choice([" id: ", " uuid ", " "]), " " + prose(), 0))
        elif kind < 0.66:
            out.append((some("0123456789", r.randint(16, 20)), prose() + r.choice([" card ", " order ", " ", " isbn "]), " " + prose(), 0))
        elif kind < 0.74:
            out.append(("/".join(word() for _ in range(r.randint(2, 5))) + r.choice(["/v2", "/2024", "1.html", "/img01.png", "-3.js"]), r.choice([prose() + " ", "https://", "./", "see "]), r.choice([" ", ".", "\n"]) + prose(), 0))
        elif kind < 0.82:
            out.append((word() + word() + r.choice(["-", "_", ""]) + word() + word() + str(r.randint(1, 2024)), prose() + " ", r.choice([" ", ".", ","]) + prose(), 0))
        elif kind < 0.92:
            fake = r.choice(["xxxxxxxxxxxxxxxx1234", "your_api_key_here_1", "EXAMPLE_TOKEN_123456", "changeme12345", "0000000000000000", "1234567890123456", "test-secret-value-1", "placeholder_value_01", "${SECRET_KEY_1}", "process.env.TOKEN_1", "aaaaaaaaaaaaaaaa1111"])
            out.append((fake, assign, quote + " " + prose(), 0))
        else:
            out.append((word() + "".join(w.capitalize() for w in (word(), word(), word())), assign, quote + " " + prose(), 0))
    body = json.dumps([{"candidate": c, "before": b[-BEFORE:], "after": a[:AFTER], "label": float(y)} for c, b, a, y in out])
    parsed = F.from_json(F.lit(body), "array<struct<candidate:string,before:string,after:string,label:double>>")
    return spark.range(0, 1, 1, 1).select(F.inline(parsed))


def fit(labelled: DataFrame) -> PipelineModel:
    """A forest over findings with columns candidate, before, after and label (0 or 1)."""
    rows, names = features(labelled.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("candidate", "before", "after")], F.col("label").cast("double")).where("label is not null"))
    forest = RandomForestClassifier(labelCol="label", featuresCol="__x", rawPredictionCol="__raw", probabilityCol="__p", predictionCol="__y", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
    return Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="__x"), forest]).fit(rows.select(*names, "label").coalesce(1))


def scan(docs: DataFrame, model: PipelineModel, text: str = "text", keep: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Findings: kept columns, start, length, kind, candidate, score and is_secret."""
    keep = C.kept(docs.columns if keep is None else keep, ADDED)
    rows, _ = features(candidates(docs, text, keep))
    judged = model.transform(rows).withColumn("score", F.round(F.element_at(vector_to_array("__p"), 2), 6))
    return judged.select(*keep, "start", "length", "kind", "candidate", "score", (F.col("score") >= threshold).alias("is_secret"))


def redact(docs: DataFrame, model: PipelineModel, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD, mark: str = MARK) -> DataFrame:
    """Documents with each secret replaced by the mark; all rows and columns stay.

    Only texts with a candidate are joined with their findings, on the id and a hash of the text (equal rows are mended alike).
    """
    names = docs.columns
    has = F.coalesce(F.col(text).rlike(PATTERN), F.lit(False))
    keys = [F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("key_id"), F.xxhash64(text).alias("key_text")]
    found = scan(docs.where(has).select(*keys, F.col(text)), model, text, ["key_id", "key_text"], threshold).where("is_secret")
    spans = found.groupBy("key_id", "key_text").agg(F.array_sort(F.collect_set(F.struct("start", "length"))).alias("__spans"))
    gaps = F.transform(
        "__spans",
        lambda s, i: F.substring(
            F.col(text),
            F.when(i > 0, F.element_at("__spans", i)["start"] + F.element_at("__spans", i)["length"]).otherwise(0) + 1,
            s["start"] - F.when(i > 0, F.element_at("__spans", i)["start"] + F.element_at("__spans", i)["length"]).otherwise(0),
        ),
    )
    last = F.element_at("__spans", -1)
    mended = F.concat(F.array_join(gaps, mark), F.lit(mark), F.substring(F.col(text), last["start"] + last["length"] + 1, F.length(text)))
    hit = docs.where(has).select("*", *keys).join(spans, ["key_id", "key_text"], "left")
    hit = hit.withColumn(text, F.when(F.col("__spans").isNotNull(), mended).otherwise(F.col(text))).select(*names)
    return docs.where(~has).unionByName(hit)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs, fit(labelled_findings(spark)), keep=["doc_id"])
    return found.withColumn("candidate_sha256", F.sha2("candidate", 256)).drop("candidate")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: secrets are replaced by a mark, with n_chars counted anew where a text changed."""
    fixed = redact(C.shielded(docs), fit(labelled_findings(spark)))
    if "n_chars" in docs.columns:
        fixed = fixed.withColumn("n_chars", F.when(F.col("text").contains(MARK), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return fixed.toDF(*docs.columns)
