"""URL filters: a rule table first, gradient-boosted trees on lexical features for the rest, in built-in functions only.

``split_url``: the host is what stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in
lower case; the path is what follows up to ``?``, ``#`` or the end. Null, or no ``://``: both empty.

Rules (verdict, host, path) fit their host and its subdomains if the path starts with the rule's; the longest
wins. URLs that a rule decides are the labelled ones. The model is fitted on at most ``TRAIN_ROWS`` of them, chosen
by a hash of the URL, with the library's distributed trees; the fitted trees become one expression of nested
comparisons, so all URLs are judged inside the scan's own stage. Suffix statistics (labelled URLs and blocked ones
under the host's last label and its last two) cover all labelled URLs; they are aggregated map-side, so a hot suffix
is one row for each task, and joined back, never broadcast by hint. A suffix without labelled URLs has the overall rate.

A labelled URL's rates leave out what its own fold of hosts has (``FOLDS`` of them, by a hash of the host), and an unlabelled
one's cover all: else the rates would tell the trees a labelled URL's label, and they would learn nothing besides.
``held_out`` measures the model on hosts that it was not fitted on, with and without the suffixes.

No labelled URLs, or labels of one kind only: the rest get that kind, or ``allow``. Repeated rows each give a row, as do those
with a null page_id, which stays null; a null URL is judged by its (empty) features. Other columns are ignored. An empty
table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most labelled URLs that the trees are fitted on; trees and their depth; seed.
TRAIN_ROWS, TREES, DEPTH, SEED = 20_000, 16, 4, 7
#: Weight of the overall rate in a suffix's rate, and folds of hosts.
PRIOR, FOLDS = 20.0, 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALLOW, BLOCK = "allow", "block"

Rule = tuple[str, str, str]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    u = F.coalesce(url, F.lit(""))
    at = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(u, at, 1), UPPER, LOWER), F.regexp_extract(u, at, 2)


def judge_by_rules(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits (its host and path), or null, and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def lexical_features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Features of the URL alone."""
    u = F.coalesce(url, F.lit(""))
    n = F.length(u)
    digits = n - F.length(F.translate(u, "0123456789", ""))
    query = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    # Entropy of the host's characters in bits: log2 n - sum(c log2 c) / n over the sorted characters' runs.
    chars = F.split(host, "")
    counts = F.transform(F.array_distinct(chars), lambda c: (F.length(host) - F.length(F.replace(host, c, F.lit("")))).cast("double"))
    hn = F.greatest(F.length(host), F.lit(1)).cast("double")
    entropy = F.aggregate(F.filter(counts, lambda c: c > 0), F.lit(0.0), lambda s, c: s - c / hn * F.log2(c / hn))
    return {
        "length": n.cast("double"),
        "host_length": F.length(host).cast("double"),
        "host_labels": F.size(F.split(host, r"\.")).cast("double"),
        "depth": F.size(F.filter(F.split(path, "/"), lambda x: x != "")).cast("double"),
        "path_length": F.length(path).cast("double"),
        "digit_ratio": digits / F.greatest(n, F.lit(1)),
        "hyphens": (F.length(host) - F.length(F.translate(host, "-", ""))).cast("double"),
        "entropy": entropy,
        "parameters": F.size(F.filter(F.split(query, "&"), lambda x: x != "")).cast("double"),
        "fragment": F.instr(u, "#").cast("boolean").cast("double"),
        "secure": u.startswith("https:").cast("double"),
        "extension": path.rlike(r"\.[A-Za-z0-9]{1,5}$").cast("double"),
        "trailing_slash": path.endswith("/").cast("double"),
        "first_segment": F.pmod(F.crc32(F.get(F.filter(F.split(path, "/"), lambda x: x != ""), F.lit(0))), F.lit(64)).cast("double"),
    }


def suffixes(host: Column) -> dict[str, Column]:
    """The host's last label and its last two."""
    return {"suffix1": F.substring_index(host, ".", -1), "suffix2": F.substring_index(host, ".", -2)}


def fit_trees(labelled: DataFrame, features: list[str]) -> list[tuple[float, object]]:
    """Weights and root nodes of trees fitted to label (1: block)."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=features, outputCol="features").transform(labelled.select("label", *(F.coalesce(F.col(f), F.lit(0.0)).alias(f) for f in features)))
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=SEED, maxBins=64, cacheNodeIds=False).fit(rows.select("features", "label"))
    return [(w, t._call_java("rootNode")) for w, t in zip(model.treeWeights, model.trees, strict=True)]


def margin(trees: list[tuple[float, object]], features: list[str]) -> Column:
    """The weighted trees as one expression; above 0 means block."""

    def tree(node) -> Column:
        if node.getClass().getSimpleName() == "LeafNode":
            return F.lit(float(node.prediction()))
        split = node.split()
        return F.when(F.coalesce(F.col(features[split.featureIndex()]), F.lit(0.0)) <= F.lit(float(split.threshold())), tree(node.leftChild())).otherwise(tree(node.rightChild()))

    return reduce(lambda a, b: a + b, (F.lit(float(w)) * tree(root) for w, root in trees))


def _fold(host: Column) -> Column:
    return F.pmod(F.xxhash64(host, F.lit(3)), F.lit(FOLDS)).cast("int")


def with_rates(rows: DataFrame, rate: float) -> DataFrame:
    """rows (host, blocked: 1.0 or 0.0 of the labelled ones, else null) with suffix1_rate and suffix2_rate, out of fold for the labelled."""
    out = rows.withColumns(suffixes(F.col("host")) | {"fold": F.when(F.col("blocked").isNotNull(), _fold(F.col("host"))).otherwise(FOLDS)})
    labelled = out.where("blocked IS NOT NULL")
    for k in ("suffix1", "suffix2"):
        by_fold = labelled.groupBy(k, "fold").agg(F.sum("blocked").alias("b"), F.count("*").alias("n"))
        total = by_fold.groupBy(k).agg(F.sum("b").alias("b"), F.sum("n").alias("n"), F.collect_list(F.struct("fold", "b", "n")).alias("own"))
        # A row for each suffix and fold, and one (FOLDS) for the unlabelled.
        each = total.select(k, "b", "n", F.explode(F.concat("own", F.array(F.struct(F.lit(FOLDS).alias("fold"), F.lit(0.0).alias("b"), F.lit(0).cast("long").alias("n"))))).alias("f"))
        stats = each.select(k, F.col("f.fold").alias("fold"), ((F.col("b") - F.col("f.b") + PRIOR * rate) / (F.col("n") - F.col("f.n") + PRIOR)).alias(f"{k}_rate"))
        out = out.join(stats, [k, "fold"], "left").withColumn(f"{k}_rate", F.coalesce(f"{k}_rate", F.lit(rate)))
    return out


def _featured(pages: DataFrame, rules: list[Rule], page_id: str, url: str) -> DataFrame:
    """page_id, url, host, path, rule, ruled (its verdict), blocked (1.0, 0.0 or null) and the lexical features."""
    host, path = split_url(F.col(url))
    base = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), host.alias("host"), path.alias("path"))
    rule, verdict = judge_by_rules(F.col("host"), F.col("path"), rules)
    judged = base.withColumns({"rule": rule, "ruled": verdict}).withColumn("blocked", (F.col("ruled") == BLOCK).cast("double"))
    return judged.withColumns(lexical_features(F.col("url"), F.col("host"), F.col("path")))


RATES = ["suffix1_rate", "suffix2_rate"]


def _names() -> list[str]:
    return list(lexical_features(F.col("url"), F.col("host"), F.col("path")))


def url_verdicts(pages: DataFrame, rules: list[Rule], page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict of every page, and score, the model's margin where no rule fits."""
    featured = _featured(pages, rules, page_id, url)
    n, n_blocked = featured.agg(F.count("blocked"), F.coalesce(F.sum("blocked"), F.lit(0.0))).first()
    if n == 0 or n_blocked in (0.0, float(n)):
        kind = BLOCK if n and n_blocked else ALLOW
        return featured.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.lit(kind)).alias("verdict"), F.lit(None).cast("double").alias("score"))
    full, names = with_rates(featured, n_blocked / n), _names() + RATES
    share = max(1, -(-int(n) // TRAIN_ROWS))
    train = full.where(F.col("blocked").isNotNull() & (F.pmod(F.xxhash64("url"), F.lit(share)) == 0)).withColumn("label", F.col("blocked"))
    score = margin(fit_trees(train, names), names)
    return full.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(score > 0, BLOCK).otherwise(ALLOW)).alias("verdict"), F.when(F.col("ruled").isNull(), score).alias("score"))


def held_out(pages: DataFrame, rules: list[Rule], page_id: str = "page_id", url: str = "url") -> DataFrame:
    """features (all, or without the suffixes' rates), n, accuracy, blocked_share and recall of blocked ones, on a fold of hosts that the trees were not fitted on."""
    labelled = _featured(pages, rules, page_id, url).where("blocked IS NOT NULL")
    n, n_blocked = labelled.agg(F.count("blocked"), F.coalesce(F.sum("blocked"), F.lit(0.0))).first()
    full = with_rates(labelled, n_blocked / max(n, 1)).withColumn("label", F.col("blocked"))
    share = max(1, -(-int(n) // TRAIN_ROWS))
    out = []
    for kind, names in (("all", _names() + RATES), ("without suffixes", _names())):
        score = margin(fit_trees(full.where((F.col("fold") != 0) & (F.pmod(F.xxhash64("url"), F.lit(share)) == 0)), names), names)
        said = full.where("fold = 0").select("label", (score > 0).alias("says"))
        out.append(said.agg(F.count("*").alias("n"), F.avg(((F.col("label") == 1) == F.col("says")).cast("double")).alias("accuracy"), F.avg("label").alias("blocked_share"), (F.count_if((F.col("label") == 1) & F.col("says")) / F.sum("label")).alias("recall")).select(F.lit(kind).alias("features"), "*"))
    return out[0].unionByName(out[1])
