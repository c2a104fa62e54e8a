"""URL filter by a path-template tree, DataFrame functions only.

Each host's paths form a tree of segments, taken level by level to its deepest path. A node whose children are variable (many distinct segments,
each seen rarely, or segments that look like numbers, ids or dates) gets one wildcard child in their place. Of a node's
other children those are merged that a G-test cannot tell from their siblings: in how their rows go on (end, wildcard, word), and in
their share of bad labels, against all labelled siblings on the same side of the node's own share; a branch without labels
takes the side whose rows go on more like its own. Merged branches are judged on their
common evidence, so labelled branches speak for unlabelled ones like them. A template is rejected where its smoothed share
of bad labels reaches a threshold. Labels are weak: a rule's verdict for the urls of rules (host, path prefix), else an
optional table of urls, else whether host or path holds a word of a list; one such url in a clean template rejects
nothing, and a clean one in a bad template goes with it. The rule that fits best decides for its own urls, the tree for all others.

Edge cases: a null url, or one without `://`, has empty host and path and is its own template; nulls in labels count as no
label; an empty table gives an empty result; repeated rows are judged alike, each on its own row; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

#: rule -> verdict. A rule fits its host and all subdomains, if the path starts with the rule's; the longest wins.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}

# Words of hosts and paths that speak for gambling, drugs, pornography, advertising, fraud or malware. They
# are weak labels, one vote for each url; the purity of a template decides.
BAD_WORDS = "spam casino bet bets betting poker slots jackpot pills viagra cialis pharma adult porn porno xxx sex escort ads adserver track tracker tracking popup malware phish phishing warez keygen crack torrent"
#: A word counts where it is whole, between the ends or signs that are no letters.
BAD_URL = r"(^|[^a-z])(" + BAD_WORDS.replace(" ", "|") + r")([^a-z]|$)"
#: G-tests at one in a hundred: of three ways to go on, and of two labels.
GO_ON, LABELS = 9.21, 6.63

WILD = "*"
#: Segments that are variable by their looks: numbers (with an extension), hex ids, dates, long mixed ids.
LEXICAL = [r"^[0-9]+(\.[a-z]+)?$", r"^[0-9a-f]{8,}$", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$", r"^[a-z_-]*[0-9][0-9A-Za-z_-]{15,}$"]
#: Upper-case letters as ASCII has them; other letters of a host stay as they are.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first `://` up to `/`, `?`, `#` or end, then up to `?`, `#` or end."""
    rest = F.when(F.locate("://", url) > 0, F.expr("substring({0}, locate('://', {0}) + 3)".format("url")))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def matched_rule(rules: dict[str, str]) -> Column:
    """The rule that fits columns host and path, else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):  # longer ones are asked first: they wrap the shorter
        site, _, prefix = rule.partition("/")
        fits = ((F.col("host") == site) | F.col("host").endswith(f".{site}")) & F.col("path").startswith(f"/{prefix}")
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def generalised(path: Column) -> Column:
    """The path's segments, those that look variable as wildcards."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    looks = lambda s: F.exists(F.array([F.lit(p) for p in LEXICAL]), lambda p: F.regexp_like(s, p))
    return F.array_join(F.transform(parts, lambda s: F.when(looks(s), F.lit(WILD)).otherwise(s)), "/")


def g_test(own: list[Column], all_: list[Column]) -> Column:
    """The G statistic of counts of some kinds in one group against the rest of all_."""
    x = lambda c: F.when(c > 0, c * F.log(c.cast("double"))).otherwise(0.0)
    total = lambda cells: sum(cells[1:], cells[0])
    rest = [b - a for a, b in zip(own, all_)]
    cells = total([x(c) for c in (*own, *rest)])
    return 2 * (cells - x(total(own)) - x(total(rest)) - total([x(c) for c in all_]) + x(total(all_)))


def template_tree(urls: DataFrame, variable_min: int = 4, variable_ratio: float = 0.5) -> DataFrame:
    """urls(host, shape, bad) -> (host, shape, template, n, labelled, bad), a row for each host and shape.

    variable_min and variable_ratio: a node with at least so many distinct children, and so many for each of its rows, is
    variable. Rows are summed per (host, shape, label) before they move; each level works on that small table alone.
    """
    tree = urls.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).withColumn("parts", F.split("shape", "/")).withColumn("template", F.lit(""))
    tree = cut_lineage(tree)
    deepest = tree.agg(F.max(F.size("parts"))).first()[0] or 0
    node, counts = ["host", "template"], ["n", "labelled", "bad", "ends", "wild"]
    for level in range(deepest):
        here = tree.withColumn("segment", F.get("parts", F.lit(level))).withColumn("next", F.get("parts", F.lit(level + 1)))
        of = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
        child = here.filter(F.col("segment").isNotNull()).groupBy(*node, "segment").agg(*(F.sum(c).alias(c) for c in counts[:3]), of(F.col("next").isNull()).alias("ends"), of(F.col("next") == WILD).alias("wild"))
        named = child.filter(F.col("segment") != WILD)
        nodes = named.groupBy(*node).agg(((F.count("*") >= variable_min) & (F.count("*") >= variable_ratio * F.sum("n"))).alias("variable"), F.sum("bad").alias("all_bad"), F.sum("labelled").alias("all_labelled"))
        above = F.when(F.col("labelled") > 0, (F.col("bad") * F.col("all_labelled") > F.col("all_bad") * F.col("labelled")).cast("int"))
        placed = cut_lineage(named.join(nodes, node).withColumn("above", above).withColumn("words", F.col("n") - F.col("ends") - F.col("wild")).withColumn("good", F.col("labelled") - F.col("bad")))
        kinds = ["ends", "wild", "words", "bad", "good"]
        in_side = lambda c, j: F.sum(F.when(F.col("above") == j, c).otherwise(0))
        sides = placed.groupBy(*node).agg(*(in_side(F.col(c), j).alias(f"{c}{j}") for j in (0, 1) for c in kinds), *(in_side(F.lit(1), j).alias(f"branches{j}") for j in (0, 1)))
        own = F.col("labelled") == 0  # such a branch is not among its side's yet
        test = lambda cells, j: g_test([F.col(c) for c in cells], [F.col(f"{c}{j}") + F.when(own, F.col(c)).otherwise(0) for c in cells])
        both = placed.join(sides, node).withColumns({f"goes{j}": test(kinds[:3], j) for j in (0, 1)} | {f"label{j}": test(kinds[3:], j) for j in (0, 1)})
        side = F.coalesce("above", F.when(F.col("branches1") == 0, 0).when(F.col("branches0") == 0, 1).otherwise((F.col("goes1") < F.col("goes0")).cast("int")))
        alike = lambda j: (side == j) & (F.col(f"branches{j}") > F.when(own, 0).otherwise(1)) & (F.col(f"goes{j}") < GO_ON) & (F.col(f"label{j}") < LABELS)
        name = F.when(F.col("variable"), F.lit(WILD)).when(alike(0), F.lit("~0")).when(alike(1), F.lit("~1")).otherwise(F.col("segment"))
        names = both.select(*node, "segment", name.alias("name"))
        step = F.concat("template", F.lit("/"), F.coalesce("name", "segment"))
        tree = cut_lineage(here.join(names, [*node, "segment"], "left").withColumn("template", F.when(F.col("segment").isNotNull(), step).otherwise(F.col("template"))).drop("segment", "next", "name"))
    return tree.drop("parts")


def verdicts(tree: DataFrame, alpha: float = 2.0, prior: float = 0.25, threshold: float = 0.5) -> DataFrame:
    """(host, shape, template, purity, verdict): templates judged on all their shapes' labels, smoothed by alpha rows of the prior."""
    judged = tree.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    purity = (F.col("bad") + alpha * prior) / (F.col("labelled") + alpha)
    judged = judged.select("host", "template", purity.alias("purity"), F.when(purity >= threshold, F.lit("block")).otherwise(F.lit("allow")).alias("judged"))
    return tree.select("host", "shape", "template").join(judged, ["host", "template"]).select("host", "shape", "template", "purity", "judged")


def filter_urls(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: dict[str, str] = RULES,
    bad_url: str | None = BAD_URL,
    labels: DataFrame | None = None,
    **tree_options: float,
) -> DataFrame:
    """(id_col, host, path, rule, verdict, template, purity) of every row of pages.

    labels(url, bad): known verdicts, 1 for bad and 0 for good, for all rows of a url; of several for a url the mean is
    rounded. bad_url: a pattern that labels other urls bad; without a table, urls without a match count as good.
    """
    rows = pages.select(F.col(id_col), F.col(url_col).alias("url")).withColumn("known", F.lit(None).cast("int"))
    if labels is not None:
        known = labels.groupBy("url").agg(F.round(F.avg(F.col("bad").cast("int"))).cast("int").alias("known"))
        rows = rows.drop("known").join(known, "url", "left")
    host, path = split_url(F.col("url"))
    rows = rows.select(id_col, host.alias("host"), path.alias("path"), "known")
    rows = rows.withColumn("rule", matched_rule(rules)).withColumn("shape", generalised(F.col("path")))
    by_rule = F.lit(None).cast("string")
    for rule, verdict in rules.items():
        by_rule = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(by_rule)
    rows = rows.withColumn("by_rule", by_rule)
    by_words = F.lit(None).cast("int")
    if bad_url:
        found = F.concat("host", F.translate("path", UPPER, LOWER)).rlike(bad_url)
        by_words = F.when(found, 1).otherwise(F.lit(0 if labels is None else None).cast("int"))
    label = F.coalesce("known", F.when(F.col("rule").isNotNull(), (F.col("by_rule") == "block").cast("int")), by_words)
    tree = template_tree(rows.select("host", "shape", label.alias("bad")), **tree_options)
    judged = verdicts(tree)
    return rows.join(judged, ["host", "shape"], "left").select(id_col, "host", "path", "rule", F.coalesce("by_rule", "judged").alias("verdict"), "template", F.round("purity", 9).alias("purity"))


def oracle(depth: int = 8) -> str:
    """DuckDB SQL for the rows of filter_urls over pages with its defaults, for paths of up to depth segments."""
    looks = " or ".join(f"regexp_matches(s, '{p}')" for p in LEXICAL)
    fits = lambda rule: f"(host = '{rule.partition('/')[0]}' or ends_with(host, '.{rule.partition('/')[0]}')) and starts_with(path, '/{rule.partition('/')[2]}')"
    longest = sorted(RULES, key=lambda r: (-len(r), r))
    rule = "case " + " ".join(f"when {fits(r)} then '{r}'" for r in longest) + " end"
    by_rule = "case rule " + " ".join(f"when '{r}' then '{v}'" for r, v in RULES.items()) + " end"
    x = lambda c: f"(case when {c} > 0 then ({c}) * ln(({c})::double) else 0.0 end)"

    kinds = ["ends", "wild", "words", "bad", "good"]

    def g(cells: list[str], j: int) -> str:
        own, all_ = [f"p.{c}" for c in cells], [f"(s.{c}{j} + case when p.labelled = 0 then p.{c} else 0 end)" for c in cells]
        rest = [f"({b} - {a})" for a, b in zip(own, all_)]
        return f"2 * ({' + '.join(x(c) for c in own + rest)} - {x(' + '.join(own))} - {x(' + '.join(rest))} - ({' + '.join(x(c) for c in all_)}) + {x(' + '.join(all_))})"

    alike = lambda j: f"side = {j} and branches{j} > case when labelled = 0 then 0 else 1 end and goes{j} < {GO_ON} and label{j} < {LABELS}"
    sums = ", ".join([f"sum(case when above = {j} then {c} else 0 end) as {c}{j}" for j in (0, 1) for c in kinds] + [f"sum(case when above = {j} then 1 else 0 end) as branches{j}" for j in (0, 1)])
    sql = f"""with u as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
hp as (select page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') as host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) as path from u),
pp as (select *, {rule} as rule, list_filter(string_split(path, '/'), lambda s: s <> '') as parts from hp),
r as materialized (select page_id, host, path, rule, {by_rule} as by_rule, array_to_string(list_transform(parts, lambda s: case when {looks} then '*' else s end), '/') as shape from pp),
t0 as materialized (select host, shape, count(*) as n, count(l) as labelled, coalesce(sum(l), 0) as bad, string_split(shape, '/') as parts, '' as template
  from (select *, case when rule is not null then (by_rule = 'block')::int else regexp_matches(host || translate(path, '{UPPER}', '{LOWER}'), '{BAD_URL}')::int end as l from r) group by host, shape)"""
    for k in range(depth):
        sql += f""",
h{k} as materialized (select *, parts[{k + 1}] as segment, parts[{k + 2}] as next from t{k}),
c{k} as materialized (select host, template, segment, sum(n) as n, sum(labelled) as labelled, sum(bad) as bad, sum(case when next is null then n else 0 end) as ends, sum(case when next = '*' then n else 0 end) as wild from h{k} where segment is not null and segment <> '*' group by all),
v{k} as materialized (select host, template, count(*) >= 4 and count(*) >= 0.5 * sum(n) as variable, sum(bad) as all_bad, sum(labelled) as all_labelled from c{k} group by all),
p{k} as materialized (select c.*, variable, case when labelled > 0 then (bad * all_labelled > all_bad * labelled)::int end as above, n - ends - wild as words, labelled - bad as good from c{k} c join v{k} v on c.host = v.host and c.template = v.template),
s{k} as materialized (select host, template, {sums} from p{k} group by all),
b{k} as materialized (select p.host, p.template, p.segment, p.variable, p.above, p.labelled, s.branches0, s.branches1, {g(kinds[:3], 0)} as goes0, {g(kinds[:3], 1)} as goes1, {g(kinds[3:], 0)} as label0, {g(kinds[3:], 1)} as label1
  from p{k} p join s{k} s on p.host = s.host and p.template = s.template),
m{k} as materialized (select host, template, segment, case when variable then '*' when {alike(0)} then '~0' when {alike(1)} then '~1' else segment end as name
  from (select *, coalesce(above, case when branches1 = 0 then 0 when branches0 = 0 then 1 else (goes1 < goes0)::int end) as side from b{k})),
t{k + 1} as materialized (select h.host, h.shape, h.n, h.labelled, h.bad, h.parts, case when h.segment is not null then h.template || '/' || coalesce(m.name, h.segment) else h.template end as template
  from h{k} h left join m{k} m on h.host = m.host and h.template = m.template and h.segment = m.segment)"""
    return f"""{sql},
j as (select host, template, (sum(bad) + 0.5) / (sum(labelled) + 2.0) as purity from t{depth} group by all)
select r.page_id, r.host, r.path, r.rule, coalesce(r.by_rule, case when j.purity >= 0.5 then 'block' else 'allow' end) as verdict, t.template, round(j.purity::double, 9) as purity
from r join t{depth} t on r.host = t.host and r.shape = t.shape join j on t.host = j.host and t.template = j.template"""
