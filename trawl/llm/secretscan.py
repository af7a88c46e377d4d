"""Secret scans in DataFrame functions only: candidates from a wide pattern, false positives removed by a random forest.

A candidate is a maximal run of 16 or more letters, digits and ``_+/.-`` (with
base-64 padding, but not with ``name=`` before it), or, right behind the name of a
secret and a sign of assignment, eight or more characters of any kind. Its
features: length, character transitions, coverage by a dictionary, path, and the
words around it, whether or not they are candidates themselves. The dictionary is
``DICTIONARY`` and the most frequent words of the documents, counted over all of
them. The forest is trained once for each scanner, on labelled findings; its trees
then become one SQL expression over the array of a text's candidates, so that a
scan is a projection: no shuffle, no join, no Python on the executors.

``labelled_findings`` scans made-up lines, with labels, from templates and a seed;
a table of real ones (``cand, before, after, path, label``) may be given instead.

Nulls, empty and odd input: a null or empty text has no candidates and stays as
it is; a null path counts as empty; texts are scanned whole; repeated rows are
scanned each by itself; an empty table gives an empty result; other columns are
kept, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.llm.shared import written

CANDIDATE = (
    r"[A-Za-z0-9_+/.\-]{16,}+(?:={1,2}(?![A-Za-z0-9_+/.=\-]))?"
    # The first two conditions follow from the third, and spare most places its many lengths.
    r"""|(?<=[\s=:"'])(?<=[=:]\s{0,2}["']?)(?<=(?i:passw(?:or)?d|pwd|secret|token|key|credential)["']?\s{0,2}[=:]{1,2}\s{0,2}["']?)[^\s"',;<>]{8,}"""
)
PLACEHOLDER = "[SECRET]"
#: Characters of text before and after a candidate that count as its neighbourhood.
BEFORE, AFTER = 64, 32
TREES, DEPTH, SEED, TRAINING_ROWS = 15, 6, 7, 6_000
LEAST = 0.5
#: Words of the documents that are added to the dictionary: the most frequent of four letters or more.
WORDS = 300

# Common words and letter pairs of English, German, French and Spanish; names near secrets, and near what looks like one.
DICTIONARY = (
    "the and for with that this from have are was not you all can her his one our out use any had how its may new now who did get has him old see two way "
    "der die das und ein eine mit von auf ist nicht sich auch als nach bei aus wie wird ung keit heit lich "
    "les des est que une pour dans par sur avec plus tion ment ait elle leur aux "
    "los las con por una del para como mas ado cion mente "
    "data file path name user test example sample value string object number list index table page image static assets content public local config default "
    "version release module package library system service server client http www com org net html json config your here change placeholder"
).split()
PAIRS = "th he in er an re on en at nd ou es ti de ch ei ie le la te ar or st se al ll".split()
NAMES = "api access auth secret token key passw pwd credential bearer private"
OTHERS = "commit sha md5 checksum digest hash uuid version example sample integrity etag revision file path img src href"


def _any(words: str) -> str:
    return "(?i)(" + "|".join(words.split()) + ")"


def features(cand: str, before: str, after: str, path: str, dictionary: tuple[str, ...] = ()) -> dict[str, str]:
    """SQL of each feature, a double, from the names of the four strings; ``dictionary`` adds to ``DICTIONARY``."""
    n = f"length({cand})"

    def share(pattern: str) -> str:
        return f"(regexp_count({cand}, '{pattern}') / {n})"

    changes = "|".join(f"(?<=[{k}])(?=[^{k}])" for k in ("a-z", "A-Z", "0-9", "_+/=.\\\\-"))
    words = "|".join(sorted({*DICTIONARY, *dictionary}, key=lambda w: (-len(w), w)))
    return {
        "size": f"CAST({n} AS DOUBLE)",
        "changes": share(changes),
        "pairs": share("(?i)(?=" + "|".join(PAIRS) + ")"),
        "digits": share("[0-9]"),
        "upper": share("[A-Z]"),
        "marks": share("[_+/=.\\\\-]"),
        "odd": share("[^A-Za-z0-9_+/=.\\\\-]"),
        "kinds": f"(size(array_distinct(split({cand}, ''))) / {n})",
        "hex": f"IF({cand} RLIKE '^([0-9a-f]+|[0-9A-F]+)$', 1D, 0D)",
        "known": f"(1D - length(regexp_replace(lower({cand}), '{words}', '')) / {n})",
        "run": f"(coalesce(array_max(transform(regexp_extract_all({cand}, '[A-Za-z]+', 0), w -> length(w))), 0) / {n})",
        "slashes": f"CAST(regexp_count({cand}, '/') AS DOUBLE)",
        "address": f"IF({before} RLIKE '(://|www[.]|@)\\\\S*$' OR {cand} RLIKE '[.](com|org|net|html?|js|css|png|jpe?g|json|txt)$', 1D, 0D)",
        "test_path": f"IF(coalesce({path}, '') RLIKE '(?i)(test|example|sample|fixture|doc)', 1D, 0D)",
        "named": f"IF({before} RLIKE '{_any(NAMES)}', 1D, 0D)",
        "named_other": f"IF({before} RLIKE '{_any(OTHERS)}', 1D, 0D)",
        "given": f"IF({before} RLIKE '[=:]\\\\s*[\"\\']?$' OR {before} RLIKE '(?i)bearer\\\\s+$', 1D, 0D)",
        "quoted": f"IF({before} RLIKE '[\"\\']$' AND {after} RLIKE '^[\"\\']', 1D, 0D)",
    }


def labelled_lines(spark: SparkSession, rows: int = TRAINING_ROWS, seed: int = SEED) -> DataFrame:
    """Lines of text, the same for the same seed: ``text, secret, path``; secret is null where there is none."""

    def draw(name: str, n: int) -> str:
        return f"CAST(pmod(xxhash64(id, {seed}, '{name}'), {n}) AS INT)"

    def one(name: str, options: list[str]) -> str:
        return f"element_at(array({', '.join(options)}), {draw(name, len(options))} + 1)"

    def text(options: str | list[str]) -> list[str]:
        return ["'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" for x in (options.split("|") if isinstance(options, str) else options)]

    digest = f"sha2(concat(id, '-{seed}'), 512)"
    packed = f"base64(unhex({digest}))"
    words = "array(" + ", ".join(text(DICTIONARY)) + ")"

    def joined(mark: str, n: int) -> str:
        return f"array_join(transform(sequence(1, {n}), k -> element_at({words}, CAST(pmod(xxhash64(id, k, '{mark}'), {len(DICTIONARY)}) AS INT) + 1)), '{mark}')"

    def plain(n: int) -> str:
        return f"regexp_replace(left({packed}, {n}), '[+/=]', 'q')"

    secret = one("secret", [f"left({digest}, 40)", f"left({digest}, 32)", f"left({digest}, 64)", f"upper(left({digest}, 40))", f"regexp_replace(left({packed}, 40), '[=]', 'x')", f"concat('AKIA', upper(left({digest}, 16)))", f"concat('ghp_', {plain(36)})", plain(24), f"concat(left({packed}, 43), '=')",
                            f"concat({plain(6)}, '!', {draw('digit', 1000)})", f"concat({plain(9)}, '#7')", f"concat(left({words}[{draw('w', len(DICTIONARY))}], 5), '@', left({digest}, 6))"])
    prefix = one("name", text("token = \"|TOKEN=|api_key: \"|secret=|password = '|password: |PASSWORD=|Authorization: Bearer |access key: |AUTH_TOKEN=|\"private_key\": \"|client_secret: |client_secret=|AWS_SECRET_ACCESS_KEY = \"|AWS_SECRET_ACCESS_KEY=|SERVICE_ACCOUNT_PASSWORD: \"|db_credentials_token=\""))
    other = one("other", [joined("", 5), joined("_", 4), joined("/", 5), joined(".", 4), joined("-", 4), "repeat('x', 24)", "repeat('-', 40)", "repeat('0', 20)", "'your_api_key_here_please'", joined("", 3), "'changeme-please'", "'<your-password>'",
                          f"regexp_replace(left({digest}, 36), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}}).*$', '$1-$2-$3-$4-$5')", f"left({digest}, 40)", f"left(regexp_replace({digest}, '[a-f]', '7'), 16)", f"concat({joined('/', 2)}, '/', left({digest}, 12), '.html')", f"concat({joined('', 6)}, {draw('number', 100)})"])
    around = one("around", text("https://|see |commit |sha1 checksum: |\"name\": \"|version |src=\"/|uuid: |id = |in the "))
    lead = one("prose", text("the |of a |, and then |\n|. |la |der |que "))
    hashed = text("commit |sha256 checksum: |digest |file revision |etag ")
    base = spark.range(rows).selectExpr("id", f"{draw('label', 2)} AS label", f"{draw('other', 17)} AS kind", f"{secret} AS secret", f"{other} AS other", f"concat({lead}, {joined(' ', 3)}, ' ') AS lead", f"{prefix} AS prefix", f"{around} AS around", f"{draw('bare', 5)} AS bare", f"{one('hash', hashed)} AS hash_name",
                                        f"{one('path', text('src/app.py|config/prod.env|web/page|src0|tests/data.txt|docs/example.md'))} AS path", f"{draw('tail', 3)} AS tail", f"{joined('_', 3)} AS long_name")
    # Digests, and dictionary words under a secret's name, show what the words around a candidate are worth.
    name = "CASE WHEN label = 1 THEN prefix WHEN kind = 13 THEN hash_name WHEN bare = 4 AND kind < 12 THEN prefix WHEN bare > 1 THEN '' ELSE around END"
    end = "IF(right(name, 1) IN ('\"', '\\''), right(name, 1), '')"
    tail = "element_at(array(' in the', concat(' and ', long_name), '\n'), tail + 1)"
    made = base.selectExpr("*", f"{name} AS name").selectExpr("*", f"{end} AS ending")
    return made.selectExpr(f"concat(lead, name, IF(label = 1, secret, other), ending, {tail}) AS text", "IF(label = 1, secret, NULL) AS secret", "path")


def labelled_findings(spark: SparkSession, rows: int = TRAINING_ROWS, seed: int = SEED) -> DataFrame:
    """What a scan finds in ``labelled_lines``: ``cand, before, after, path, label``."""
    lines = labelled_lines(spark, rows, seed)
    each = candidates(lines, "text", "path").select(F.col("row.secret").alias("secret"), "path", F.explode("z").alias("c"))
    return each.select("c.cand", "c.before", "c.after", "path", F.coalesce(F.col("c.cand") == F.col("secret"), F.lit(False)).cast("int").alias("label"))


def frequent_words(docs: DataFrame, text_col: str = "text", most: int = WORDS) -> tuple[str, ...]:
    """The most frequent words of all documents, of four letters or more (without accents); ties go to the smaller word."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit("[a-z]{4,}"), F.lit(0))).alias("w"))
    return tuple(r.w for r in words.groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(most).collect())


@dataclass(frozen=True)
class Scanner:
    """A dictionary, and the votes of a forest that was trained with it, as SQL."""

    dictionary: tuple[str, ...]
    votes: str


def scanner(docs: DataFrame, text_col: str = "text", labelled: DataFrame | None = None) -> Scanner:
    """One for these documents; ``labelled``: findings to train on (``cand, before, after, path, label``)."""
    words = frequent_words(docs, text_col)
    return Scanner(words, votes(train(labelled_findings(docs.sparkSession) if labelled is None else labelled, words), words))


def train(labelled: DataFrame, dictionary: tuple[str, ...] = (), trees: int = TREES, depth: int = DEPTH, seed: int = SEED):
    """A random forest on ``cand, before, after, path, label``."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    names = features("cand", "before", "after", "path", dictionary)
    # The forest reads its rows several times: as a table, they are made once.
    table = written(labelled.selectExpr(*(f"CAST({sql} AS DOUBLE) AS {name}" for name, sql in names.items()), "CAST(label AS DOUBLE) AS label"), "secret-training")
    vectors = VectorAssembler(inputCols=list(names), outputCol="x").transform(table).select("x", "label").coalesce(1)
    return RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, maxBins=64).fit(vectors)


def votes(model, dictionary: tuple[str, ...] = ()) -> str:
    """The share of trees that take ``x`` (a struct of features) for a secret, as SQL."""
    names = list(features("cand", "before", "after", "path", dictionary))

    def sql(node) -> str:
        if node.getClass().getSimpleName() == "LeafNode":
            return f"{node.prediction():.0f}"
        split = node.split()
        left, right = sql(node.leftChild()), sql(node.rightChild())
        return left if left == right else f"IF(x.{names[split.featureIndex()]} <= {split.threshold()!r}D, {left}, {right})"

    trees = [sql(t._java_obj.rootNode()) for t in model.trees]
    return "(" + " + ".join(trees) + f") / {len(trees)}D"


def candidates(docs: DataFrame, text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """``row`` (the input row), ``path``, ``z`` (its candidates: ``part`` of the text since the one before, ``cand``, and the text ``before`` and ``after`` it) and ``rest`` (the text after the last)."""
    path = F.col(path_col).cast("string") if path_col and path_col in docs.columns else F.lit("")
    text = F.col(text_col)
    rows = docs.select(F.struct("*").alias("row"), path.alias("path"), F.split(text, CANDIDATE, -1).alias("parts"), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("cands"))
    n = F.size("cands")
    zipped = F.arrays_zip(F.col("cands").alias("cand"), F.slice("parts", F.lit(1), n).alias("part"), F.slice("parts", F.lit(2), n).alias("next"))
    rows = rows.select("row", "path", zipped.alias("y"), F.element_at("parts", -1).alias("rest"))
    # Two candidates and what lies between them fill the neighbourhood, but for short passwords.
    earlier = f"coalesce(right(get(y, i - 2).cand, {BEFORE}), ''), coalesce(right(get(y, i - 1).part, {BEFORE}), ''), coalesce(right(get(y, i - 1).cand, {BEFORE}), '')"
    later = f"coalesce(left(get(y, i + 1).cand, {AFTER}), '')"
    described = f"named_struct('part', c.part, 'cand', c.cand, 'before', right(concat({earlier}, right(c.part, {BEFORE})), {BEFORE}), 'after', left(concat(left(c.next, {AFTER}), {later}), {AFTER}))"
    return rows.select("row", "path", F.expr(f"transform(y, (c, i) -> {described})").alias("z"), "rest")


def scanned(docs: DataFrame, model: Scanner | None = None, text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """``row`` (the input row), ``found`` (its candidates: ``part`` before it, ``cand``, ``score``) and ``rest`` (the text after the last)."""
    model = model or scanner(docs, text_col)
    named = ", ".join(f"'{name}', CAST({sql} AS DOUBLE)" for name, sql in features("c.cand", "c.before", "c.after", "path", model.dictionary).items())
    described = candidates(docs, text_col, path_col).select("row", F.expr(f"transform(z, c -> named_struct('cand', c.cand, 'part', c.part, {named}))").alias("d"), "rest")
    return described.select("row", F.expr(f"transform(d, x -> named_struct('part', x.part, 'cand', x.cand, 'score', {model.votes}))").alias("found"), "rest")


def findings(docs: DataFrame, model: Scanner | None = None, least: float = LEAST, id_col: str = "doc_id", **columns) -> DataFrame:
    """``id_col, n_candidates, n_secrets, secrets`` of every row; secrets: an array of ``start`` (code points before it), ``secret``, ``score``."""
    one = scanned(docs, model, **columns)
    lengths = F.transform("found", lambda x: F.length(x.part) + F.length(x.cand))
    placed = one.select(F.col("row").getField(id_col).alias(id_col), F.coalesce(F.size("found"), F.lit(0)).alias("n"), F.transform("found", lambda x, k: F.struct(x.cand.alias("secret"), x.score.alias("score"), k.alias("k"))).alias("s"), lengths.alias("lengths"))
    some = placed.select(id_col, F.when(F.col("n") > 0, F.col("n")).otherwise(0).cast("long").alias("n_candidates"), F.filter("s", lambda x: x.score >= least).alias("s"), "lengths")
    at = F.expr("transform(s, x -> named_struct('start', CAST(aggregate(slice(lengths, 1, x.k + 1), 0, (a, b) -> a + b) - length(x.secret) AS BIGINT), 'secret', x.secret, 'score', x.score))")
    return some.select(id_col, "n_candidates", F.greatest(F.size("s"), F.lit(0)).cast("long").alias("n_secrets"), F.coalesce(at, F.expr("array()").cast("array<struct<start:bigint,secret:string,score:double>>")).alias("secrets"))


def redacted(docs: DataFrame, model: Scanner | None = None, least: float = LEAST, text_col: str = "text", **columns) -> DataFrame:
    """The rows of ``docs`` with each secret replaced by a placeholder."""
    one = scanned(docs, model, text_col=text_col, **columns)
    new = F.concat(F.array_join(F.transform("found", lambda x: F.concat(x.part, F.when(x.score >= least, F.lit(PLACEHOLDER)).otherwise(x.cand))), ""), F.col("rest"))
    return one.select(*((new if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns))
