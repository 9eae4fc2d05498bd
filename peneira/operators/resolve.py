"""Entity resolution of records by address, identity and meaning."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peneira.functions.text import words_only
from peneira.functions.urls import canonical_url
from peneira.operators.components import connected
from peneira.session import staged

# Title words that mean the same, words that don't tell jobs apart, titles that name no job.
SYNONYMS = {
    "desenvolvedora": "desenvolvedor", "developer": "desenvolvedor", "dev": "desenvolvedor", "engenheira": "engenheiro", "programadora": "programador",
    "jr": "junior", "sr": "senior", "pl": "pleno", "estagiario": "estagio", "estagiaria": "estagio",
}
TITLE_NOISE = [
    "remoto", "remota", "remote", "home", "office", "hibrido", "hibrida", "hybrid", "presencial", "onsite", "100", "vaga", "brasil", "brazil", "pessoa", "a", "o",
]
# Pairs of words that are written as one.
JOINED = {"back": "end", "front": "end", "full": "stack"}
GENERIC_TITLES = ["aprendiz", "estagio", "estagiario", "pcd", "programa de estagio"]
COMPANY_SUFFIXES = ["ltda", "sa", "s", "a", "me", "eireli", "inc", "brasil", "br", "do", "group"]
REMOTE = "remoto|remota|remote|home office|teletrabalho"


def identity_key(source: Column, job_id: Column, url: Column, company: Column, title: Column, location: Column) -> Column:
    """`kind|value`: the job id in its source, else the canonical address, else a hash of company, title and location."""
    canonical = canonical_url(url)
    fallback = F.sha2(F.lower(F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in (company, title, location)])), 256)
    return (
        F.when(F.trim(job_id) != "", F.concat(F.lit("SOURCE_JOB_ID|"), source, F.lit(":"), F.trim(job_id)))
        .when(canonical != "", F.concat(F.lit("CANONICAL_URL|"), canonical))
        .otherwise(F.concat(F.lit("FALLBACK_HASH|"), fallback))
    )


def title_key(title: Column) -> Column:
    """The words of a title that tell the job, in one spelling.

    Every word is replaced by what it adds to the key: a synonym's common word,
    nothing for noise, both halves of a pair for its first half and nothing for
    the second.
    """
    words = F.split(words_only(F.coalesce(title, F.lit(""))), " ")
    adds = {**SYNONYMS, **dict.fromkeys(TITLE_NOISE, "")}
    single = F.create_map(*[F.lit(x) for pair in adds.items() for x in pair])
    pairs = F.create_map(*[F.lit(x) for a, b in JOINED.items() for x in (f"{a} {b}", a + b)])
    after = lambda i: F.try_element_at(pairs, F.concat_ws(" ", F.try_element_at(words, i + 1), F.try_element_at(words, i + 2)))
    told = F.transform(words, lambda w, i: F.coalesce(after(i), F.when((i > 0) & after(i - 1).isNotNull(), F.lit("")), F.try_element_at(single, w), w))
    return F.array_join(F.filter(told, lambda w: w != ""), " ")


def company_key(company: Column) -> Column:
    """A company's words written together up to the last that is no legal form or country; the first word always stays."""
    text = words_only(F.coalesce(company, F.lit("")))
    return F.replace(F.regexp_replace(text, f"(?: (?:{'|'.join(COMPANY_SUFFIXES)}))+$", ""), F.lit(" "), F.lit(""))


def exact_duplicates(records: DataFrame, order: str) -> DataFrame:
    """(order, kept, conflict) of records with url_key and id_key: what the sequential rule keeps.

    In order, a record is dropped if its address was kept before, else if its
    identity was; a dropped record registers nothing. Two job ids at one
    address are a conflict: neither is kept. The rule is replayed within
    connected components of addresses and identities, so components run in
    parallel; one component is one task, which holds the keys it took. Records with equal keys are collapsed to
    their first before the replay; conflicts are found by a join with what was taken.
    """
    keyed = staged(records.select(F.col(order).alias("ord"), F.when(F.col("url_key") != "", F.col("url_key")).alias("url"), F.col("id_key").alias("key"), "job"), "keyed")
    nodes = keyed.select("ord", "url", "key", "job", F.xxhash64(F.lit("u"), "url").alias("a"), F.xxhash64(F.lit("i"), "key").alias("b"))
    roots = _roots(nodes.where("url is not null").select("a", "b").distinct())
    placed = nodes.join(roots, "b", "left").withColumn("root", F.coalesce("root", "b"))
    firsts = placed.groupBy("root", "url", "key").agg(F.min(F.struct("ord", "job")).alias("f")).select("root", "url", "key", "f.*")
    counted = firsts.withColumn("n", F.count("*").over(Window.partitionBy("root")))
    alone = counted.where("n = 1").select("ord", "url", "job")
    ordered = counted.where("n > 1").repartition("root").sortWithinPartitions("root", "ord").select("root", "ord", "url", "key", "job")
    taken = staged(alone.unionAll(ordered.mapInArrow(_replay, "ord bigint, url string, job string")), "taken")
    owners = taken.where("url is not null").select("url", F.col("ord").alias("owner"), F.col("job").alias("own"))
    judged = keyed.join(owners, "url", "left").withColumn("later", F.coalesce((F.col("ord") > F.col("owner")) & (F.col("job") != "") & (F.col("own") != "") & (F.col("job") != F.col("own")), F.lit(False)))
    accused = judged.where("later").select(F.col("owner").alias("ord")).distinct().withColumn("bad", F.lit(True))
    out = judged.join(taken.select("ord", F.lit(True).alias("took")), "ord", "left").join(accused, "ord", "left")
    bad = F.coalesce("bad", F.lit(False))
    return out.select(F.col("ord").alias(order), (F.coalesce("took", F.lit(False)) & ~bad).alias("kept"), (F.col("later") | bad).alias("conflict"))


def _roots(edges: DataFrame) -> DataFrame:
    """(b, root) of the identities (b) that addresses (a) link to others.

    An address of one identity links nothing. Identities that share one address
    and no other are a group at once, its least is the root. Only what is left,
    identities with several shared addresses, goes through the rounds of
    connected().
    """
    shared = staged(edges.join(edges.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a"), "a", "left_semi"), "shared")
    if shared.isEmpty():
        return shared.select("b", F.col("a").alias("root"))
    ways = shared.groupBy("b").agg(F.count("*").alias("n"))
    stars = shared.join(ways, "b").groupBy("a").agg(F.max("n").alias("most"), F.min("b").alias("root"))
    judged = shared.join(stars, "a")
    known = judged.where("most = 1").select("b", "root")
    left = judged.where("most > 1").select("a", "b")
    return known if left.isEmpty() else known.unionAll(connected(left).select(F.col("node").alias("b"), "root"))


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of each component that are taken in order: neither their address nor their identity was taken before."""
    root, urls, keys = None, set(), set()
    for batch in batches:
        taken = []
        for i, (of, url, key) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("root", "url", "key")])):
            if of != root:
                root, urls, keys = of, set(), set()
            if (url is not None and url in urls) or key in keys:
                continue
            keys.add(key)
            if url is not None:
                urls.add(url)
            taken.append(i)
        at = pa.array(taken, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(c).take(at) for c in ("ord", "url", "job")], ["ord", "url", "job"])


def semantic_clusters(records: DataFrame, order: str) -> DataFrame:
    """records with a column cluster: which of the greedy first-fit cliques of its (title, company) group a record joins.

    Two records fit if their places are equal or one has no place or is remote.
    A record without a fixed place fits all, so it always joins the first
    clique; so does the place that comes first; every other place is a clique
    of its own. That closed form needs no pass over a group in order: two
    window aggregates. Records without a key stay alone (cluster is null).
    """
    place = words_only(F.coalesce("location", F.lit("")))
    remote = (F.coalesce("workplace_model", F.lit("")) == "REMOTE") | words_only(F.concat_ws(" ", "title", "location")).rlike(REMOTE)
    fixed = F.when((place != "") & ~remote, place)
    keyed = records.withColumn("t_", title_key(F.col("title"))).withColumn("c_", company_key(F.col("company"))).withColumn("fixed_", fixed)
    usable = (F.col("t_") != "") & (F.col("c_") != "") & ~words_only(F.coalesce("title", F.lit(""))).isin(GENERIC_TITLES)
    first = keyed.where(usable & F.col("fixed_").isNotNull()).groupBy("t_", "c_").agg(F.min_by("fixed_", order).alias("first_"))
    joined = keyed.withColumn("u_", usable).join(first, ["t_", "c_"], "left")
    own = F.when(F.col("fixed_").isNull() | (F.col("fixed_") == F.col("first_")), "").otherwise(F.col("fixed_"))
    return joined.withColumn("cluster", F.when(F.col("u_"), F.concat_ws("|", "t_", "c_", own))).drop("t_", "c_", "fixed_", "first_", "u_")


def keep_one(clustered: DataFrame, order: str, published: Column, best_source: Column) -> DataFrame:
    """One record per cluster: of the best source, within one source the newest, else the first; with ALSO_SEEN_IN and
    REPOSTED labels. Records without a cluster stay."""
    # The clusters are read four times below: once computed, they are kept.
    own = staged(clustered.withColumn("p_", published).withColumn("s_", best_source), "clusters")
    alone = own.where("cluster is null").drop("p_", "s_", "cluster")
    groups = own.where("cluster is not null").groupBy("cluster").agg(F.countDistinct("source").alias("sources_"), F.min("s_").alias("best_"), F.collect_set("source").alias("all_"))
    rated = own.where("cluster is not null").join(groups, "cluster").where("s_ = best_")
    newest = F.when(F.col("sources_") == 1, F.coalesce(F.unix_micros("p_"), F.lit(-(2**62)))).otherwise(F.lit(0))
    ranked = rated.withColumn("r_", F.row_number().over(Window.partitionBy("cluster").orderBy(newest.desc(), F.col(order)))).where("r_ = 1")
    counts = own.where("cluster is not null").groupBy("cluster", "source").agg((F.count("*") - 1).alias("again_"))
    full = ranked.join(counts, ["cluster", "source"])
    extra = F.concat(F.transform(F.array_sort(F.array_remove("all_", F.col("source"))), lambda s: F.concat(F.lit("ALSO_SEEN_IN:"), s)), F.when(F.col("again_") > 0, F.array(F.concat(F.lit("REPOSTED:"), "again_"))).otherwise(F.array().cast("array<string>")))
    labels = F.array_sort(F.array_distinct(F.concat(F.coalesce("match_labels", F.array().cast("array<string>")), extra)))
    kept = full.withColumn("match_labels", F.when(F.size(extra) > 0, labels).otherwise(F.col("match_labels")))
    return alone.unionByName(kept.select(*alone.columns))
