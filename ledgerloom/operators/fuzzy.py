"""Name matching: candidates by keys that every pair alike enough must share, then the measure itself."""

from __future__ import annotations

import uuid
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


def with_folder(spark) -> None:
    """Checkpoints go to the folder that the cluster names; in one process without any, to a temporary one."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        folder = "file://" + tempfile.mkdtemp(prefix="checkpoint-")
    context.setCheckpointDir(folder)


class Tables:
    """Tables written to a new folder below the shared one, which cuts lineage; each is computed once."""

    def __init__(self, spark):
        with_folder(spark)
        self.spark, self.root, self.count = spark, f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/names-{uuid.uuid4().hex}", 0

    def write(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path).hint("merge")  # packed files look small enough for the driver


def similar_pairs(names: DataFrame, also: list[str], least: float) -> DataFrame:
    """(i, j, a, b): names equal in ``also`` and their first three letters whose edit similarity is at least ``least``.

    A name of n letters takes part in k = (1 - least) n edits at most with names not longer than it, and deletes no
    more of its own letters towards longer ones. Up to two edits, names within reach are equal after such deletions; names
    that allow more, and those long enough to meet them, share one of their k q + 1 rarest letter pairs (q = 2), so
    names of any length take part. Groups of names that differ in a letter or two are the result itself.
    """
    if not 0.7 <= least <= 1:
        raise ValueError("letter pairs are complete from 0.7 on")
    n = names.withColumn("low", F.lower("name")).withColumn("block", F.substring("low", 1, 3)).withColumn("size", F.length("low"))
    edits = lambda size: F.floor(F.lit(1 - least) * size + 1e-9).cast("int")
    deleted = lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))
    one = deleted(F.col("low"))
    two = F.flatten(F.transform(one, deleted))
    k = edits(F.col("size"))
    keys = F.array_distinct(F.concat(F.array("low"), F.when(k >= 1, one).otherwise(F.array().cast("array<string>")), F.when(k >= 2, two).otherwise(F.array().cast("array<string>"))))
    kept = ["block", *also, "id", "name", "low", "size"]
    short = n.where(k <= 2).select(*kept, F.explode(keys).alias("key"))

    reach = edits(F.col("size") / least)  # edits towards the longest partner
    grams = n.where((reach > 2) & (F.col("size") > 1)).select(*kept, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda i: F.substring("low", i, F.lit(2))))).alias("gram"))
    rare = grams.groupBy("block", *also, "gram").agg(F.count("*").alias("df"))
    of = grams.join(rare, ["block", *also, "gram"]).groupBy(*kept).agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("g"))
    long = of.select(*kept, F.explode(F.transform(F.slice("g", F.lit(1), 2 * reach + 1), lambda g: g["gram"])).alias("key"))

    def met(keyed: DataFrame) -> DataFrame:
        left = keyed.select("block", *also, "key", F.col("id").alias("i"), F.col("name").alias("a"), F.col("low").alias("x"))
        right = keyed.select("block", *also, "key", F.col("id").alias("j"), F.col("name").alias("b"), F.col("low").alias("y"))
        near = 1 - F.levenshtein("x", "y") / F.greatest(F.length("x"), F.length("y"), F.lit(1))
        return left.join(right, ["block", *also, "key"]).where((F.col("i") < F.col("j")) & (near >= least)).select("i", "j", "a", "b")

    return met(short).unionByName(met(long)).distinct()


LONG = 9  # words from which a name's sets are not written out


def alike_names(cores: DataFrame, least: float = 0.85, blocked: bool = True, either: bool = False) -> DataFrame:
    """(i, j): distinct match names of ``cores(n, core)``, by number, with similarity of at least ``least``; ``blocked``: only of equal first three letters.

    The measure takes the name with the smaller number first, which matters for names of as many words; ``either``: in either order.

    Every step of the measure that reaches ``least`` leaves an equal key, and keys that many names share are told apart by
    the sizes that can meet:
    * a cut-off name is a prefix of the other, within the steps' lengths (all such pairs are results);
    * a glued name is equal without blanks (all such pairs are results);
    * of a name whose words begin the first words of another, one word at its place is the rarest beginning there,
      and the other name has it among the beginnings of its words; of these pairs only those stay that begin so at all places;
    * the mix needs a word overlap of (least - 0.43) / 0.5. For s and t words that fixes how many are equal, so
      a set of that many words is a key of the pair of sizes; from nine words on the rarest words are keys.
    """
    if least < 0.75:
        raise ValueError("keys are complete from 0.75 on")
    overlap = (least - 0.43) / 0.5 - 1e-9
    words = F.split("core", " ")
    c = cores.where(F.length("core") > 0).select("n", "core", words.alias("w"), F.array_sort(F.array_distinct(F.filter(words, lambda x: x != ""))).alias("set"))

    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        both = left.join(right.withColumnRenamed("n", "m"), "key").where("n <> m")
        return both.select(F.least("n", "m").alias("i"), F.greatest("n", "m").alias("j"))

    length = F.length("core")
    whole = c.select("n", F.col("core").alias("key"))
    cuts = F.filter(F.sequence(F.lit(1), F.lit(20)), lambda r: (r < length) & ((r <= 3) | ((r <= 10) & (length - r >= 10)) | ((length - r >= 15) & (F.size(F.split(F.substring("core", F.lit(1), length - r), " ")) == F.size("w") - 1))))
    cut = c.select("n", F.explode(F.transform(cuts, lambda r: F.substring("core", F.lit(1), length - r))).alias("key"))
    glued = c.select("n", F.replace("core", F.lit(" "), F.lit("")).alias("key"))

    at = lambda k, x: F.concat(k.cast("string"), F.lit(":"), x)
    starts = F.flatten(F.transform("w", lambda x, k: F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda z: z <= F.length(x)), lambda z: at(k, F.substring(x, F.lit(1), z)))))
    begun = c.select("n", "w", F.explode(starts).alias("key"))
    often = begun.groupBy("key").agg(F.count("*").alias("df"))
    own = c.where(F.size("w") >= 2).select("n", "w", F.posexplode("w").alias("k", "x")).where("x <> ''").select("n", "w", at(F.col("k"), F.col("x")).alias("key"))
    rarest = own.join(often, "key").groupBy("n", "w").agg(F.min(F.struct("df", "key")).alias("r")).select("n", "w", F.col("r.key").alias("key"))
    all_begin = F.forall(F.zip_with(F.slice("v", F.lit(1), F.size("w")), "w", lambda x, y: x.startswith(y)), lambda x: x)
    begins = rarest.join(begun.select(F.col("n").alias("m"), F.col("w").alias("v"), "key"), "key").where((F.col("n") != F.col("m")) & (F.size("w") <= F.size("v")) & all_begin)
    begins = begins.select(F.least("n", "m").alias("i"), F.greatest("n", "m").alias("j"))

    need = lambda s, t: -(-overlap / (1 + overlap) * (s + t) // 1)  # noqa: E731  equal words for sizes s and t
    sized = c.withColumn("s", F.size("set"))
    family = F.array().cast("array<struct<t:int,key:string>>")
    for s in range(1, LONG):
        held = [F.struct(F.lit(t).alias("t"), key.alias("key")) for t in range(1, LONG) if (o := int(need(s, t))) <= min(s, t) for key in _subsets(s, o)]
        family = F.when(F.col("s") == s, F.array(*held)).otherwise(family)
    family = sized.select("n", "s", F.explode(family).alias("f")).select("n", "s", "f.t", "f.key")
    other = family.select(F.col("n").alias("m"), F.col("s").alias("t"), F.col("t").alias("s"), "key")
    sets = family.join(other, ["s", "t", "key"]).where((F.col("s") < F.col("t")) | ((F.col("s") == F.col("t")) & (F.col("n") < F.col("m")))).select(F.least("n", "m").alias("i"), F.greatest("n", "m").alias("j"))

    lengthy = sized.where(F.col("s") >= int(LONG * overlap))
    tokens = lengthy.select("n", "s", F.explode("set").alias("key"))
    rare = tokens.groupBy("key").agg(F.count("*").alias("df"))
    of = tokens.join(rare, "key").groupBy("n", "s").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("w"))
    some = F.slice("w", F.lit(1), F.col("s") - F.ceil(F.col("s") * overlap).cast("int") + 1)
    rare_words = of.select("n", "s", F.explode(F.transform(some, lambda x: x["key"])).alias("key"))
    long = met(rare_words.where(F.col("s") >= LONG).drop("s"), rare_words.drop("s"))

    pairs = met(whole, cut).unionByName(met(glued, glued)).unionByName(begins).unionByName(sets).unionByName(long).distinct()
    one, two = cores.select(F.col("n").alias("i"), F.col("core").alias("x")), cores.select(F.col("n").alias("j"), F.col("core").alias("y"))
    both = pairs.join(one, "i").join(two, "j")
    if blocked:
        both = both.where(F.substring("x", 1, 3) == F.substring("y", 1, 3))
    near = S.name_similarity(F.col("x"), F.col("y")) >= least
    return both.where(near | (S.name_similarity(F.col("y"), F.col("x")) >= least) if either else near).select("i", "j")


def _subsets(s: int, size: int) -> list[Column]:
    """All subsets of ``size`` of the ``s`` sorted words, each as a text."""
    return [F.concat_ws(" ", *[F.get("set", k) for k in pick]) for pick in combinations(range(s), size)]


def led_by(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(n, leader) of ``nodes(n)`` under ``edges(i, j)``, i < j: each node joins its smallest leading neighbour before it, else leads.

    Greedy and order-dependent by definition. In each round the nodes without an undecided earlier
    neighbour lead and their later neighbours are settled, so rounds follow chains, not the number of nodes; the
    smallest undecided node is settled in every round, so chains of any length end.
    """
    tables = Tables(nodes.sparkSession)
    edges = tables.write(edges)
    state = tables.write(nodes.select("n", F.lit(None).cast("boolean").alias("role")))  # true leads, false has a leader
    while not (open_ := state.where("role is null").select("n")).isEmpty():
        waits = edges.join(open_.withColumnRenamed("n", "i"), "i", "left_semi").select(F.col("j").alias("n")).distinct().withColumn("waits", F.lit(True))
        leads = open_.join(waits, "n", "left_anti")
        led = edges.join(leads.withColumnRenamed("n", "i"), "i", "left_semi").select(F.col("j").alias("n")).distinct().withColumn("led", F.lit(True))
        state = state.join(led, "n", "left").join(leads.withColumn("leads", F.lit(True)), "n", "left")
        state = tables.write(state.select("n", F.when(F.col("role").isNotNull(), F.col("role")).when(F.col("leads"), True).when(F.col("led"), False).alias("role")))
    first = edges.join(state.where("role").select(F.col("n").alias("i")), "i").groupBy(F.col("j").alias("n")).agg(F.min("i").alias("l"))
    return state.join(first, "n", "left").select("n", F.when(F.col("role"), F.col("n")).otherwise(F.col("l")).alias("leader"))


def greedy_groups(names: DataFrame, least: float = 0.85) -> DataFrame:
    """(id, core, leader): each name joins the first leader of its block, by smallest id of its core name, that is similar enough, else leads."""
    tables = Tables(names.sparkSession)
    cores = tables.write(names.select("id", S.match_name(F.col("name")).alias("core")))
    distinct = tables.write(cores.groupBy("core").agg(F.min("id").alias("n")).where("core is not null"))
    led = led_by(distinct, alike_names(distinct, least)).withColumnRenamed("leader", "l")
    named = led.join(distinct.select("n", "core"), "n").join(distinct.select(F.col("n").alias("l"), F.col("core").alias("leader")), "l").select("core", "leader")
    return cores.join(named, "core").select("id", "core", "leader")


def company_groups(names: DataFrame, least: float = 0.75) -> DataFrame:
    """(id, name, leader, canonical, size): companies of ``names(id, name)`` grouped without blocks, ids deciding who is first.

    Names are equal too if their normal forms are; ``leader`` is the first name's id, ``canonical`` the longest normal form of
    the group, the first of equals. Null names take no part; ids must be unique.
    """
    tables = Tables(names.sparkSession)
    named = names.where("name is not null").select("id", "name", S.match_name(F.col("name")).alias("core"), S.company_name(F.col("name")).alias("normal"))
    named = tables.write(named.withColumn("norm", F.lower("normal")))
    nodes = tables.write(named.groupBy("core", "norm").agg(F.min("id").alias("n")))
    cores = nodes.groupBy("core").agg(F.min("n").alias("c"))
    links = alike_names(cores.select(F.col("c").alias("n"), "core"), least, blocked=False, either=True)
    with_core = nodes.join(cores, "core").select("n", "c", "norm", "core")
    side = lambda n, c, *more: with_core.select(F.col("n").alias(n), F.col("c").alias(c), *more)
    across = links.join(side("a", "i", F.col("core").alias("x")), "i").join(side("b", "j", F.col("core").alias("y")), "j")
    first = F.col("a") < F.col("b")
    across = across.where(S.name_similarity(F.when(first, F.col("x")).otherwise(F.col("y")), F.when(first, F.col("y")).otherwise(F.col("x"))) >= least).select("a", "b")
    inside = side("a", "c").join(side("b", "c"), "c").join(cores.where(F.length("core") > 0).select("c"), "c", "left_semi").select("a", "b")
    norms = with_core.select(F.col("n").alias("a"), "norm").join(with_core.select(F.col("n").alias("b"), "norm"), "norm").select("a", "b")
    edges = across.unionByName(inside).unionByName(norms).where("a <> b").select(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j")).distinct()
    led = led_by(nodes.select("n"), edges)
    found = named.join(nodes, ["core", "norm"]).join(led, "n")
    facts = found.groupBy("leader").agg(F.min_by("normal", F.struct(-F.length("normal"), F.col("id"))).alias("canonical"), F.count("*").alias("size"))
    return found.select("id", "name", "leader").join(facts, "leader")
