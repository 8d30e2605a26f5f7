"""Secret scanning with a random forest that removes false positives.

Candidates are found word by word: all runs of at least 16 key characters with a digit; what
is assigned to a name of a secret, in the same word or the next ones; and passwords in the
user part of an address. Each is described by its length, its kinds of characters and how
often they change, how probable its letters follow each other in words rather than at random,
the share of it that dictionary words cover, whether it begins like a public token format or
looks like part of a path or address, and what is around it: the words before, and in its own
word the text from the end of the last run but one before it up to the next one. A random
forest trained from labelled findings gives the probability of a secret; its trees are applied
as conditional expressions. Everything on the main path is a DataFrame function.

The dictionary is the ``most_words`` most frequent words of the whole corpus, counted in all
documents, with a few words of technical names; the probabilities of letters come from the
same words. The findings to learn from are generated from public formats with a fixed seed
(see ``labelled_findings``); a table of a user's own, with the columns ``text`` and
``secret``, can be given instead. At most ``most`` rows of it are used for the fit.

Defined results: a null or empty text has no candidates; a candidate that occurs several
times is reported at each word; null ids are returned as null, repeated rows are reported
repeatedly; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import random
import string
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of an assigned value, at least.
LEAST = 6
_NAME = (
    r"(?:pass(?:word|wd|phrase|code)?|pwd|(?<![a-z])(?:secret|token|api[_\-]?key|access[_\-]?key|private[_\-]?key|key|credential|auth)s?)(?![a-z])"
)
_GLUED = rf"(?i){_NAME}[\w.\-]*[\"']?(?:=>?|:)[\"']?([^\s\"'&,;<>{{}}()=:/][^\s\"'&,;<>{{}}()]{{{LEAST - 1},}})"
_USER = r"(?i)[a-z][a-z0-9+.\-]*://[^\s:/@]*:([^\s/@]{3,})@"
_KEY = r"[A-Za-z0-9+/_\-]{16,}={0,2}"
#: Words that name a secret, and words that name something else.
NAMES = "token secret password passwd pwd key apikey api auth authorization bearer credential private access".split()
OTHERS = (
    "commit sha sha1 sha256 md5 checksum hash digest revision uuid guid id etag version build release image "
    "example sample test dummy placeholder number card account isbn order invoice phone"
).split()
#: How tokens of public formats begin.
KNOWN = r"^(?:A[KS]IA[A-Z0-9]|gh[pousr]_|github_pat_|glpat-|xox[abeoprs]-|[sr]k_(?:live|test)_|AIza|ya29|eyJ|npm_|SG\.|hf_|dop_v1_)"
#: Words whose letters are no random letters.
DICTIONARY = (
    "the and for that with this from have test user name pass word example sample dummy data file path index page "
    "table value string number order item list home main admin local host server client service system config "
    "default public private static class type object method function model train batch version release build "
    "image video audio text html http www com org net your here change insert todo null true false january "
    "monday key token secret"
).split()
FEATURES = ["length", "digits", "uppers", "lowers", "hexes", "marks", "changes", "flow", "covered", "known", "path", "address", "assigned", "named", "other"]


def candidates(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` without the text, a row per candidate: its word's ``place``, ``candidate``,
    what is ``before`` it in the word, the part of the ``word`` around it and the ``around``
    words, lower case."""
    words = F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+")
    kept = [F.col(f"`{c}`") for c in rows.columns if c != text]
    listed = rows.select(*kept, words.alias("_w"))

    def assigned(i: Column) -> Column:
        own, last, name = F.get("_w", i), F.get("_w", i - 1), F.get("_w", i - 2)
        sign = F.endswith(last, F.lit("=")) | F.endswith(last, F.lit(":"))
        named = last.rlike(rf"(?i){_NAME}[\w.\-]*[\"']?\s*[=:]$") | (F.length(last) <= 2) & name.rlike(rf"(?i){_NAME}[\w.\-]*[\"']?$")
        return F.coalesce(sign & (F.length(own) >= LEAST) & named, F.lit(False))

    def wanted(i: Column) -> Column:
        own = F.get("_w", i)
        run = (F.length(own) >= 16) & own.rlike(_KEY) & own.rlike("[0-9]")
        glued = (F.contains(own, F.lit("=")) | F.contains(own, F.lit(":"))) & (own.rlike(_GLUED) | own.rlike(_USER))
        return run | glued | assigned(i)

    found = F.transform(
        F.filter(F.sequence(F.lit(0), F.size("_w") - 1), wanted),
        lambda i: F.struct(
            i.alias("place"),
            F.get("_w", i).alias("word"),
            assigned(i).alias("_value"),
            F.lower(F.array_join(F.slice(F.col("_w"), F.greatest(F.lit(1), i - 3), F.least(i, F.lit(4))), " ")).alias("around"),
        ),
    )
    # no filter on the array: pushed down, it would split the text anew for every word
    one = listed.select(*kept, F.explode(found).alias("_f")).select(*kept, "_f.*")
    # every run of the word, and the text between them: one more piece than there are runs
    pieces = one.withColumns({"_runs": F.regexp_extract_all("word", F.lit(f"({_KEY})"), F.lit(1)), "_gaps": F.split("word", _KEY)})
    runs = F.transform(
        "_runs",
        lambda r, i: F.struct(
            r.alias("candidate"),
            F.concat_ws("", F.get("_gaps", i - 1), F.get("_runs", i - 1), F.get("_gaps", i)).alias("before"),
            F.get("_gaps", i + 1).alias("after"),
        ),
    )
    runs = F.filter(runs, lambda r: r["candidate"].rlike("[0-9]"))
    # assigned values that hold no such run
    bare = F.regexp_extract("word", r"^[\"'(\[{]*(.*?)[\"')\]},;.]*$", 1)
    values = F.array_distinct(
        F.concat(
            F.regexp_extract_all("word", F.lit(_GLUED), F.lit(1)),
            F.regexp_extract_all("word", F.lit(_USER), F.lit(1)),
            F.when(F.col("_value"), F.array(bare)).otherwise(F.array().cast("array<string>")),
        )
    )
    values = F.filter(values, lambda v: (F.length(v) >= 3) & ~F.exists("_runs", lambda r: F.contains(v, r) & r.rlike("[0-9]")))
    values = F.transform(values, lambda v: F.struct(v.alias("candidate"), F.call_function("substring_index", F.col("word"), v, F.lit(1)).alias("before"), F.lit("").alias("after")))
    each = pieces.select(*kept, "place", "around", F.explode(F.concat(runs, values)).alias("_r"))
    each = each.select(*kept, "place", "around", "_r.candidate", "_r.before", F.col("_r.after").alias("_after"))
    return each.withColumn("word", F.concat("before", "candidate", "_after")).drop("_after")


@dataclass(frozen=True)
class Words:
    """A dictionary, and the logarithm of how much more probable than at random a letter
    follows another one in it."""

    known: frozenset[str]
    follows: dict[str, float]


def vocabulary(docs: DataFrame | None = None, text_col: str = "text", most_words: int = 4000, fewest: int = 3) -> Words:
    """Learns from the most frequent words of all texts that occur ``fewest`` times;
    ``most_words`` bounds what the driver gets."""
    counted = [(w, 1) for w in DICTIONARY]
    if docs is not None:
        word = F.explode(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^\p{L}]+")).alias("w")
        often = docs.select(word).filter(F.length("w").between(3, 20)).groupBy("w").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= fewest)
        counted += [(r["w"], r["n"]) for r in often.orderBy(F.desc("n"), "w").limit(most_words).collect()]
    letters = string.ascii_lowercase
    pairs = {a + b: 0.5 for a in letters for b in letters}
    for w, n in counted:
        for pair in map("".join, zip(w, w[1:])):
            if pair in pairs:
                pairs[pair] += math.log1p(n)
    after = {a: sum(pairs[a + b] for b in letters) for a in letters}
    return Words(frozenset(w for w, _ in counted), {p: math.log(26 * n / after[p[0]]) for p, n in pairs.items()})


def described(found: DataFrame, words: Words) -> DataFrame:
    """The candidates with their features."""
    c, n = F.col("candidate"), F.length("candidate").cast("double")
    share = lambda p: F.length(F.regexp_replace(c, p, "")).cast("double") / n
    kinds = F.translate(c, string.ascii_lowercase + string.ascii_uppercase + string.digits, "a" * 26 + "A" * 26 + "0" * 10)
    runs = F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")).cast("double")
    parts = F.split(F.lower(F.regexp_replace(c, r"([a-z])([A-Z])", "$1 $2")), r"[^\p{L}]+")
    covered = F.aggregate(F.filter(parts, lambda p: p.isin(sorted(words.known))), F.lit(0), lambda s, p: s + F.length(p))
    table = F.create_map(*[F.lit(x) for pair in sorted(words.follows.items()) for x in pair])
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.try_element_at(table, F.substring(F.lower(c), i, F.lit(2))))
    pairs = F.filter(pairs, lambda x: x.isNotNull())
    around = F.concat(F.col("around"), F.lit(" "), F.lower(F.col("before")))
    has = lambda words, but="": around.rlike(r"(?<![a-z])%s(?:%s)(?![a-z])" % (but, "|".join(words))).cast("double")
    return found.select(
        "*",
        n.alias("length"),
        share("[^0-9]").alias("digits"),
        share("[^A-Z]").alias("uppers"),
        share("[^a-z]").alias("lowers"),
        share("[^0-9a-fA-F]").alias("hexes"),
        share("[A-Za-z0-9]").alias("marks"),
        (runs / n).alias("changes"),
        (F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(pairs), F.lit(1))).alias("flow"),
        (covered / n).alias("covered"),
        c.rlike(KNOWN).cast("double").alias("known"),
        F.col("word").rlike(r"://|^[/~.]|\.[a-z]{2,4}\b|/.*/").cast("double").alias("path"),
        (F.col("before").rlike(r"://[^/@]*$") & ~c.rlike(r"[/@]")).cast("double").alias("address"),
        F.concat(F.col("around"), F.lit(" "), F.col("word")).rlike(r"[=:]\s*[\"']?\s*\S*$").cast("double").alias("assigned"),
        has(NAMES).alias("named"),
        has(OTHERS, r"(?<!key[_\-])").alias("other"),
    )


def labelled_findings(n: int = 3000, seed: int = 7, words: Sequence[str] = DICTIONARY) -> list[tuple[str, int]]:
    """Texts with one finding each, and whether it is a secret: keys, tokens and passwords of
    public formats in assignments, addresses and prose against checksums, identifiers,
    numbers, paths, placeholders and plain values."""
    rng = random.Random(seed)
    some = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    base64, hexes = string.ascii_letters + string.digits, "0123456789abcdef"

    def word() -> str:
        return rng.choice([rng.choice(words), rng.choice(DICTIONARY), some(string.ascii_lowercase, rng.randint(2, 9))])

    def prose(k: int) -> str:
        return " ".join(word() for _ in range(rng.randint(0, k)))

    def secret() -> str:
        return rng.choice(
            [
                lambda: some(hexes, rng.choice([32, 40, 64])),
                lambda: some(hexes, 40).upper(),
                lambda: "AKIA" + some(string.ascii_uppercase + string.digits, 16),
                lambda: "ghp_" + some(base64, 36),
                lambda: "sk_live_" + some(base64, 24),
                lambda: some(base64 + "+/", rng.choice([22, 40, 43])) + rng.choice(["", "=", "=="]),
                lambda: some(base64, rng.randint(20, 48)),
                lambda: ".".join(["eyJ" + some(base64, 30), "eyJ" + some(base64, 60), some(base64 + "_-", 43)]),
                lambda: rng.choice(["npm_", "hf_", "xoxp-1"]) + some(base64, 34),
            ]
        )()

    def password() -> str:
        mixed = some(base64 + "!#$%*+-?^_~", rng.randint(8, 20))
        return rng.choice([mixed, mixed, rng.choice(words).capitalize() + some(string.digits, rng.randint(2, 4)) + rng.choice("!#$?*")]) + rng.choice("0123456789!")

    def harmless() -> tuple[str, str]:
        return rng.choice(
            [
                lambda: (rng.choice(["commit", "sha", "sha1", "checksum", "md5", "hash", "revision", "etag"]), some(hexes, rng.choice([32, 40, 64]))),
                lambda: (rng.choice(["uuid", "id", "guid", word()]), "-".join(some(hexes, k) for k in (8, 4, 4, 4, 12))),
                lambda: (rng.choice(["card", "number", "account", "order", word(), word()]), some(string.digits, rng.randint(16, 19))),
                lambda: (word(), "/" + "/".join(word() for _ in range(rng.randint(2, 4))) + f"/{word()}{rng.randint(1, 999)}"),
                lambda: (word(), f"https://www.{word()}.com/{word()}/{word()}-{word()}-{rng.randint(1, 99999)}"),
                lambda: (word(), "_".join([word(), rng.choice(DICTIONARY), rng.choice(DICTIONARY), word(), str(rng.randint(1, 99))])),
                lambda: (rng.choice(NAMES), "-".join(["your", rng.choice(NAMES), "here", "example", str(rng.randint(1, 999))])),
                lambda: (rng.choice(NAMES), "example" + rng.choice(DICTIONARY) + rng.choice(DICTIONARY) + "1234567890"),
                lambda: (word(), some(string.ascii_lowercase, rng.randint(14, 20)) + str(rng.randint(1, 9))),
                lambda: (rng.choice(NAMES), rng.choice([w for w in words if len(w) >= LEAST] or ["required"])),
                lambda: (rng.choice(NAMES), "_".join([rng.choice(words), rng.choice(DICTIONARY)]) + rng.choice(["", "()", ".value"])),
                lambda: (rng.choice(NAMES), f"20{rng.randint(10, 30)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}"),
                lambda: (rng.choice(NAMES), f"${{{rng.choice(DICTIONARY).upper()}_{rng.choice(NAMES).upper()}}}"),
            ]
        )()

    def sign() -> tuple[str, str]:
        return rng.choice([(" = ", ""), ("=", ""), (": ", ""), (' = "', '"'), (" ", ""), ('="', '"'), (": '", "'"), ('": "', '"}'), (': "', '",')])

    rows = []
    for k in range(n):
        left, right = sign()
        if k % 14 == 1:
            own = rng.choice([f"{word()}:{password()}", f"{word()}:{some(base64, 12)}1", secret().replace("/", "x"), "x:" + secret().replace("/", "x")])
            text = f"{prose(5)} {rng.choice(['https', 'postgres', 'amqp', 'redis', 'mysql'])}://{own}@{word()}.{rng.choice(['com', 'org', 'local'])}/{word()} {prose(4)}"
            rows.append((text.strip(), 1))
            continue
        if k % 14 in (3, 5, 7):
            name = rng.choice(["password", "passwd", "pwd", f"{word()}_password", f"{word()}_passwd", "secret", "token"])
            rows.append((f"{prose(5)} {name}{left if left != ' ' else ': '}{password()}{right} {prose(4)}".strip(), 1))
            continue
        if k % 14 == 9:  # an access key's id
            rows.append((f"{prose(5)} {rng.choice(['aws_access_key_id', 'access_key_id', 'key_id', 'id'])}{left}AKIA{some(string.ascii_uppercase + string.digits, 16)}{right}", 1))
            continue
        if k % 2:
            name, value = rng.choice([rng.choice(NAMES), f"{rng.choice(NAMES)}_{rng.choice(NAMES)}"]), secret()
            if left == " ":
                left = " = "
        else:
            name, value = harmless()
        text = f"{prose(5)} {name}{left}{value}{right} {prose(4)}".strip()
        rows.append((rng.choice([text, text, text, text.upper()]), k % 2))
    return rows


def forest(spark: SparkSession, words: Words, labelled: DataFrame | None = None, trees: int = 15, depth: int = 7, seed: int = 11, most: int = 20_000) -> Column:
    """The probability that a described candidate is a secret, as an expression."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    if labelled is None:
        own = sorted(w for w in words.known if w.isascii()) or DICTIONARY
        # rows in the plan itself: no data of the driver goes through Python workers
        rows = ", ".join("('%s', %d)" % (t.replace("\\", "\\\\").replace("'", "\\'"), s) for t, s in labelled_findings(words=own))
        labelled = spark.sql(f"SELECT * FROM VALUES {rows} AS t(text, secret)")
    labelled = labelled.select("text", F.col("secret").cast("double").alias("secret")).limit(most)
    sample = described(candidates(labelled), words).dropDuplicates(["secret", "candidate", "around"])
    sample = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(sample).select("secret", "features").coalesce(1)
    learner = RandomForestClassifier(
        labelCol="secret", numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt", minInstancesPerNode=5
    )
    model = learner.fit(sample)

    def expression(node) -> Column:
        if node.subtreeDepth() == 0:
            stats = list(node.impurityStats().stats())
            return F.lit(float(stats[1] / sum(stats)))
        split = node.split()
        test = F.col(FEATURES[split.featureIndex()]) <= float(split.threshold())
        return F.when(test, expression(node.leftChild())).otherwise(expression(node.rightChild()))

    votes = [expression(t._call_java("rootNode")) for t in model.trees]
    return reduce(lambda a, b: a + b, votes) / len(votes)


def findings(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = 0.5,
    labelled: DataFrame | None = None,
    most_words: int = 4000,
) -> DataFrame:
    """One row per candidate: id, the word's ``place``, the ``candidate``, its ``score``
    and whether it ``is_secret``."""
    words = vocabulary(docs, text_col, most_words)
    score = forest(docs.sparkSession, words, labelled)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    found = described(candidates(rows, "_text"), words).withColumn("score", F.round(score, 6))
    return found.select(
        F.col("_id").alias(id_col),
        F.col("place").cast("long").alias("place"),
        "candidate",
        "score",
        (F.col("score") >= threshold).alias("is_secret"),
    )
