"""URL filters by a path-template tree, in DataFrame functions only.

Rules decide the urls that they fit; the others are judged by the tree. Per host, every path segment is generalised:
runs of digits become ``{n}``, long hexadecimal words ``{x}``. The tree is built from the counts of distinct generalised
paths, down to their last segments. Below a node, literal segments that are many and rare are variable: they are one branch
``{*}`` with the sum of their counts. Then branches are merged where their shares of good urls are alike: in order of that share, a
new template begins where two neighbours differ beyond chance (two proportions, ``Z``), or where one differs from the whole
node beyond chance and the other does not; branches without labels are one template. A template's purity is its share of labelled urls
that are good, drawn towards the node's purity by ``PRIOR`` urls; a host's is drawn towards the share over all hosts. Segments that all paths of a node
share are passed over, since they tell nothing apart. A path whose last template has a purity below ``REJECT`` is rejected.
Below a node without labels, or all of whose paths have labels of one kind, no branches can differ: that is one pass for all depths, shown as ``**``; so is
a run of segments that all paths that go on share. The number of rounds is thus that of mixed forks on a path, not that of its levels.
The labels are the rules' verdicts unless others are given. A template shows the literals that it stands for.

Cases: a null url, or one without ``://``, has an empty host and path, and all such urls share one node; repeated rows
are judged each; an empty table gives an empty table; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, checkpointed, spread_join, table

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
FANOUT, RARE, PRIOR, REJECT, Z = 20, 0.02, 5, 0.35, 1.96
#: Levels that the SQL form is written out for; deeper paths than these are in no given table.
SQL_LEVELS = 6


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    url = F.coalesce(url, F.lit(""))
    pattern = "(?s)^.*?://([^/?#]*)([^?#]*)"
    return ascii_lower(F.regexp_extract(url, pattern, 1)), F.regexp_extract(url, pattern, 2)


def longest_rule(host: Column, path: Column, rules: tuple) -> Column:
    """The longest rule that fits, as (verdict, rule); null without one. The rules are a short list."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        of_host, slash, of_path = rule.partition("/")
        fits = ((host == of_host) | F.endswith(host, F.lit("." + of_host))) & F.startswith(path, F.lit(slash + of_path))
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def generalised(path: Column) -> Column:
    """The generalised segments of a path."""
    return F.transform(F.array_remove(F.split(path, "/"), ""), lambda s: F.regexp_replace(F.regexp_replace(s, "[0-9a-f]{12,}", "{x}"), r"[0-9]+", "{n}"))


def purity(good: Column, n: Column, prior: Column) -> Column:
    return (good + F.lit(float(PRIOR)) * prior) / (n + F.lit(float(PRIOR)))


def apart(g: Column, n: Column, g2: Column, n2: Column) -> Column:
    """Whether the shares g of n and g2 of n2 differ beyond chance."""
    off, both = (g * n2 - g2 * n).cast("double"), n + n2
    return off * off * both > F.lit(Z * Z) * (g + g2).cast("double") * (both - g - g2) * n * n2


def differs_at(x: Column, y: Column) -> Column:
    """The first place, from 0, where two arrays differ, an end counting as different; null if they are equal."""
    return F.nullif(F.array_position(F.zip_with(x, y, lambda p, q: ~p.eqNullSafe(q)), True), F.lit(0)) - 1


def shown(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda x: F.concat(F.lit("/"), x)), "")


def passed_over(tree: DataFrame) -> DataFrame:
    """tree, with the segments that all of a node's paths share moved from rest to template, and what is known of the node: is_last: nothing is
    left to tell its paths apart; plain: none of its urls has a label; pure: all paths have labels, all of one kind; high: the last rest."""
    ends = tree.groupBy("host", "node").agg(F.min("rest").alias("low"), F.max("rest").alias("high"), F.sum("labelled").alias("l"), F.sum("good").alias("g"), F.min("labelled").alias("least"))
    shared = F.coalesce(differs_at(F.col("low"), F.col("high")), F.size("low")).cast("int")
    pure = (F.col("least") > 0) & ((F.col("g") == 0) | (F.col("g") == F.col("l")))
    ends = ends.select("host", "node", shared.alias("shared"), (F.col("low") == F.col("high")).alias("is_last"), (F.col("l") == 0).alias("plain"), pure.alias("pure"), "l", "g", F.slice("high", shared + 1, F.size("high")).alias("high"))
    rows = spread_join(tree, ends, ["host", "node"], F.col("rest"))
    return rows.withColumns({"template": F.concat("template", shown(F.slice("rest", 1, F.col("shared")))), "rest": F.slice("rest", F.col("shared") + 1, F.size("rest"))}).drop("shared")


def stepped(state: Column, step: Column) -> Column:
    """The state of a walk down a node's paths after one depth: the purity of those that go on, their number and labels, and the purity of
    those that have ended at each depth. The end of a path is a branch, and so is what goes on: they are one template unless they differ."""
    n, l, g = state.n - step.n, state.l - step.l, state.g - step.g
    split = step.differs | ((step.n > 0) & (n > 0))

    def side(l: Column, g: Column) -> Column:
        own = apart(g, l, state.g, state.l)
        return F.when(l == 0, F.lit(None)).when(own & (g * state.l > state.g * l), 1).when(own, -1).otherwise(0)

    one = side(step.l, step.g).eqNullSafe(side(l, g)) & ~apart(step.g, step.l, g, l)
    last, on = (F.when(~split, state.p).when(one, purity(state.g, state.l, state.p)).otherwise(purity(y, x, state.p)) for x, y in ((step.l, step.g), (l, g)))
    return F.struct(on.alias("p"), n.alias("n"), l.alias("l"), g.alias("g"), F.concat(state.out, F.array(F.struct(step.d.alias("d"), last.alias("p")))).alias("out"))


def walked_down(tree: DataFrame) -> DataFrame:
    """tree (of nodes that are not plain), as far down as what goes on is known without the branches' counts, in one pass for all depths: all the way where
    the node is pure, as its branches are then one template, and else while all paths that go on share their segments. ended: whether the path ends there."""
    fork = differs_at(F.col("rest"), F.col("high"))
    tree = tree.withColumn("size", F.size("rest"))
    forks = tree.groupBy("host", "node").agg(F.count(F.lit(1)).alias("n"), F.first("l").alias("l"), F.first("g").alias("g"), F.first("purity").alias("p"),
        F.when(F.first("pure"), F.max("size") + 1).otherwise(F.coalesce(F.min(F.when(fork < F.col("size"), fork)), F.max("size"))).cast("int").alias("upto"), F.max(F.coalesce(fork < F.col("size"), F.lit(False))).alias("forks"))
    forks = checkpointed(forks)
    tree = checkpointed(spread_join(tree.drop("high", "l", "g"), forks.select("host", "node", "upto", "forks"), ["host", "node"], F.col("rest")))
    end = F.struct(F.col("size").alias("d"), F.lit(None).cast("string").alias("segment"), F.lit(True).alias("ends"))
    on = F.transform("rest", lambda x, i: F.struct(i.alias("d"), x.alias("segment"), F.lit(False).alias("ends")))
    places = tree.filter("size < upto").select("host", "node", "labelled", "good", F.explode(F.when(F.col("pure"), F.concat(on, F.array(end))).otherwise(F.array(end))).alias("x")).select("host", "node", "labelled", "good", "x.*")
    ended = {x: F.coalesce(F.sum(F.when(F.col("ends"), y)), F.lit(0)).alias(x) for x, y in (("n", F.lit(1)), ("l", F.col("labelled")), ("g", F.col("good")))}
    steps = places.groupBy("host", "node", "d").agg(*ended.values(), F.coalesce(F.min("segment") < F.max("segment"), F.lit(False)).alias("differs")).filter("n > 0 or differs")
    steps = steps.groupBy("host", "node").agg(F.array_sort(F.collect_list(F.struct("d", "n", "l", "g", "differs"))).alias("steps"))  # one for each depth
    start = F.struct("p", "n", "l", "g", F.array().cast("array<struct<d:int,p:double>>").alias("out"))
    walk = forks.join(steps, ["host", "node"]).select("host", "node", F.aggregate("steps", start, stepped).alias("w"))
    walk = forks.select("host", "node", "p").join(walk, ["host", "node"], "left").select("host", "node", F.coalesce("w.p", "p").alias("p"), F.map_from_entries(F.coalesce("w.out", F.array().cast("array<struct<d:int,p:double>>"))).alias("out"))
    rows = spread_join(tree, walk, ["host", "node"], F.col("rest"))
    above = F.col("size") < F.col("upto")
    name = F.concat("template", F.when(F.col("pure"), "/**").otherwise(shown(F.slice("rest", 1, F.col("upto")))))
    return rows.select("host", "shape", "n", "labelled", "good", F.when(above, F.try_element_at("out", "size")).otherwise(F.col("p")).alias("purity"), "node", name.alias("template"), F.slice("rest", F.col("upto") + 1, F.col("size") + 1).alias("rest"), (above | ~F.col("forks")).alias("ended"))


def merged_branches(tree: DataFrame) -> DataFrame:
    """(host, node, segment) with the template that it belongs to: its number, name and labels. The end of a path is the segment ""."""
    branches = checkpointed(tree.groupBy("host", "node", "segment").agg(F.sum("n").alias("n"), F.sum("labelled").alias("l"), F.sum("good").alias("g")))
    nodes = branches.groupBy("host", "node").agg(F.sum("n").alias("node_n"), F.sum("l").alias("node_l"), F.sum("g").alias("node_g"), F.count_if(F.col("segment") != "").alias("fan"))
    rare = (F.col("fan") > FANOUT) & (F.col("n") < F.lit(RARE) * F.col("node_n")) & (F.col("segment") != "")
    kind = F.when(F.col("segment") == "", 0).when(rare, 2).otherwise(1)
    b = spread_join(branches, nodes, ["host", "node"], F.col("segment")).withColumn("kind", kind).withColumn("name", F.when(kind == 2, "{*}").otherwise(F.col("segment")))
    # From here on a node has few rows: its end, its variable branch, and its literals, each of RARE of its urls or among FANOUT.
    few = b.groupBy("host", "node", "kind", "name").agg(F.sum("l").alias("l"), F.sum("g").alias("g"), F.first("node_l").alias("node_l"), F.first("node_g").alias("node_g"))
    labelled = F.col("l") > 0
    own = apart(F.col("g"), F.col("l"), F.col("node_g"), F.col("node_l"))
    side = F.when(~labelled, F.lit(None)).when(own & (F.col("g") * F.col("node_l") > F.col("node_g") * F.col("l")), 1).when(own, -1).otherwise(0)
    order = W.partitionBy("host", "node").orderBy(labelled, (F.col("g").cast("double") / F.nullif("l", F.lit(0))).asc_nulls_first(), "kind", "name")
    few = few.withColumn("side", side)
    begins = ~F.lag("side").over(order).eqNullSafe(F.col("side")) | F.coalesce(apart(F.col("g"), F.col("l"), F.lag("g").over(order), F.lag("l").over(order)), F.lit(False))
    few = few.withColumn("begins", begins.cast("int")).withColumn("number", F.sum("begins").over(order))
    whole = W.partitionBy("host", "node", "number")
    members = F.array_sort(F.collect_list("name").over(whole))
    few = few.select("host", "node", "kind", "name", "number", F.when(F.size(members) == 1, members[0]).otherwise(F.concat(F.lit("("), F.array_join(members, "|"), F.lit(")"))).alias("shown"), F.sum("l").over(whole).alias("t_l"), F.sum("g").over(whole).alias("t_g"))
    return spread_join(b.select("host", "node", "segment", "kind", "name"), few, ["host", "node", "kind", "name"], F.col("segment")).drop("kind", "name")


def template_purities(paths: DataFrame, scratch: Scratch) -> DataFrame:
    """paths (host, shape, n, labelled, good; one row a shape) with the path's template and its purity. Rounds are written as tables: a
    checkpoint keeps Spark's estimate of its size, a product over all joins, whose digits would double with each round."""
    paths = scratch.write(paths)
    root = paths.groupBy().agg(((F.coalesce(F.sum("good"), F.lit(0)) + 1.0) / (F.coalesce(F.sum("labelled"), F.lit(0)) + 2.0)).alias("root"))
    hosts = paths.groupBy("host").agg(F.sum("labelled").alias("l0"), F.sum("good").alias("g0")).join(F.broadcast(root))  # root is one row
    hosts = hosts.select("host", purity(F.col("g0"), F.col("l0"), F.col("root")).alias("purity"))
    tree = spread_join(paths, hosts, ["host"], F.col("shape")).withColumns({"node": F.lit(""), "template": F.lit(""), "rest": F.col("shape")})
    done = []
    found = ["host", "shape", "template", "purity"]
    while True:  # a round a level at which good urls are mixed with others below one node, and the paths that go on differ
        tree = scratch.write(passed_over(tree))
        done.append(tree.filter("is_last").select(found))
        done.append(tree.filter("plain and not is_last").withColumn("template", F.concat("template", F.lit("/**"))).select(found))
        tree = tree.filter("not plain and not is_last")
        if tree.isEmpty():
            break
        tree = scratch.write(walked_down(tree))
        done.append(tree.filter("ended").select(found))
        tree = tree.filter("not ended").withColumn("segment", F.coalesce(F.get("rest", F.lit(0)), F.lit("")))
        if tree.isEmpty():
            break
        tree = scratch.write(spread_join(tree, merged_branches(tree), ["host", "node", "segment"], F.col("rest")).select(
            "host", "shape", "n", "labelled", "good", purity(F.col("t_g"), F.col("t_l"), F.col("purity")).alias("purity"), F.concat_ws("/", "node", "number").alias("node"),
            F.concat_ws("/", "template", "shown").alias("template"), F.slice("rest", 2, F.size("rest") + 1).alias("rest"), (F.col("segment") == "").alias("ended")))
        done.append(tree.filter("ended").select(found))
        tree = tree.filter("not ended").drop("ended")
    return reduce(DataFrame.unionByName, done)


def judge(pages: DataFrame, rules: tuple = RULES, labels: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity of every url. labels: page_id and good (boolean)."""
    host, path = parts(F.col("url"))
    seen = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("shape", generalised(F.col("path"))).withColumn("ruled", longest_rule(F.col("host"), F.col("path"), rules))
    label = F.col("ruled.verdict") == "allow"
    if labels is not None:
        seen, label = seen.join(labels.groupBy("page_id").agg(F.max("good").alias("good")), "page_id", "left"), F.col("good")
    paths = seen.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"), F.count(label).alias("labelled"), F.count(F.when(label, 1)).alias("good"))
    with Scratch(pages.sparkSession) as scratch:
        judged = checkpointed(template_purities(paths, scratch))
    verdict = F.coalesce(F.col("ruled.verdict"), F.when(F.col("purity") < REJECT, "block").otherwise("allow"))
    return spread_join(seen, judged, ["host", "shape"], F.col("page_id")).select(F.col("page_id").cast("long"), "host", "path", F.col("ruled.rule").alias("rule"), verdict.alias("verdict"), "template", "purity")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _oracle() -> str:
    ruled = "CASE " + " ".join(f"WHEN (host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}') THEN '{r}'" for _, r in sorted(RULES, key=lambda r: -len(r[1]))) + " END"
    sql = f"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
p AS (SELECT page_id, lower(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's')) AS host, regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's') AS path FROM u),
r AS (SELECT *, {ruled} AS rule FROM p),
s AS (SELECT *, rule IN ({", ".join(f"'{r}'" for v, r in RULES if v == "allow")}) AS good,
  list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: regexp_replace(regexp_replace(x, '[0-9a-f]{{12,}}', '{{x}}', 'g'), '[0-9]+', '{{n}}', 'g')) AS shape FROM r),
root AS (SELECT (count(*) FILTER (good) + 1.0::DOUBLE) / (count(good) + 2.0::DOUBLE) AS root FROM s),
t0 AS (SELECT host, shape, count(*) AS n, count(good) AS l, count(*) FILTER (good) AS g FROM s GROUP BY host, shape),
h AS (SELECT host, (sum(g) + {float(PRIOR)}::DOUBLE * any_value(root)) / (sum(l) + {float(PRIOR)}::DOUBLE) AS purity FROM t0, root GROUP BY host),
x0 AS (SELECT t0.*, purity, '' AS node FROM t0 JOIN h USING (host))"""
    apart = "power(CAST({g} * {m} - {h} * {l} AS DOUBLE), 2) * ({l} + {m}) > " + f"{Z * Z!r}::DOUBLE" + " * CAST({g} + {h} AS DOUBLE) * ({l} + {m} - {g} - {h}) * {l} * {m}"
    of_node, of_last = apart.format(g="g", l="l", h="ng", m="nl"), apart.format(g="g", l="l", h="lag(g) OVER w", m="lag(l) OVER w")
    for d in range(1, SQL_LEVELS + 1):
        sql += f""",
a{d} AS (SELECT *, coalesce(shape[{d}], '') AS seg FROM x{d - 1} WHERE len(shape) >= {d - 1}),
b{d} AS (SELECT host, node, seg, sum(n) AS n, sum(l)::BIGINT AS l, sum(g)::BIGINT AS g FROM a{d} GROUP BY ALL),
c{d} AS (SELECT *, sum(n) OVER w AS nn, (sum(l) OVER w)::BIGINT AS nl, (sum(g) OVER w)::BIGINT AS ng, count(*) FILTER (seg <> '') OVER w AS fan, count(*) OVER w AS many FROM b{d} WINDOW w AS (PARTITION BY host, node)),
e{d} AS (SELECT *, CASE WHEN seg = '' THEN 0 WHEN fan > {FANOUT} AND n < {RARE}::DOUBLE * nn THEN 2 ELSE 1 END AS kind FROM c{d}),
f{d} AS (SELECT host, node, kind, CASE kind WHEN 2 THEN '{{*}}' ELSE seg END AS name, sum(l)::BIGINT AS l, sum(g)::BIGINT AS g, any_value(nl) AS nl, any_value(ng) AS ng, any_value(many) AS many FROM e{d} GROUP BY ALL),
g{d} AS (SELECT *, CASE WHEN l = 0 THEN NULL WHEN NOT {of_node} THEN 0 WHEN g * nl > ng * l THEN 1 ELSE -1 END AS side FROM f{d}),
i{d} AS (SELECT *, CAST(lag(side) OVER w IS DISTINCT FROM side OR coalesce({of_last}, false) AS INT) AS begins FROM g{d} WINDOW w AS (PARTITION BY host, node ORDER BY l > 0, CAST(g AS DOUBLE) / nullif(l, 0) NULLS FIRST, kind, name)),
j{d} AS (SELECT *, sum(begins) OVER w AS number FROM i{d} WINDOW w AS (PARTITION BY host, node ORDER BY l > 0, CAST(g AS DOUBLE) / nullif(l, 0) NULLS FIRST, kind, name ROWS UNBOUNDED PRECEDING)),
k{d} AS (SELECT *, sum(l) OVER w AS tl, sum(g) OVER w AS tg FROM j{d} WINDOW w AS (PARTITION BY host, node, number)),
x{d} AS (SELECT a.host, a.shape, a.n, a.l, a.g, CASE WHEN e.many = 1 THEN a.purity ELSE (tg + {float(PRIOR)}::DOUBLE * a.purity) / (tl + {float(PRIOR)}::DOUBLE) END AS purity, a.node || '/' || number AS node
  FROM a{d} a JOIN e{d} e ON a.host = e.host AND a.node = e.node AND a.seg = e.seg JOIN k{d} k ON e.host = k.host AND e.node = k.node AND e.kind = k.kind AND CASE e.kind WHEN 2 THEN '{{*}}' ELSE e.seg END = k.name
  UNION ALL SELECT host, shape, n, l, g, purity, node FROM x{d - 1} WHERE len(shape) < {d - 1})"""
    return sql + f"""
SELECT page_id, s.host, path, rule, CASE WHEN good IS NULL THEN CASE WHEN purity < {REJECT} THEN 'block' ELSE 'allow' END WHEN good THEN 'allow' ELSE 'block' END AS verdict
FROM s JOIN x{SQL_LEVELS} x ON s.host = x.host AND s.shape = x.shape"""


QUERIES = {"op2_url_filters": op2_url_filters}
ORACLES = {"op2_url_filters": _oracle()}
