"""Where a column comes from, followed object by object with a rule that changes with what is met."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import Laid, laid, spread, written


def _near(asked: DataFrame, flow: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, up, qualified, name): the named nodes up to two steps upstream of each asked node, itself left out."""
    steps = laid(flow.select(F.col("down").alias("here"), "up"), "here").hint("merge")
    one = asked.select("node", F.col("node").alias("here")).join(steps, "here").select("node", "up")
    two = one.select("node", F.col("up").alias("here")).join(steps, "here").select("node", "up")
    return one.unionByName(two).where("node <> up").join(nodes.select(F.col("id").alias("up"), "qualified", "name"), "up").select("node", "up", "qualified", "name")


def _resolved(own: DataFrame, loaded: DataFrame, flow: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, col, source, object, to, hit): the maps that count, each with the node (up, qualified) that its object means.

    Maps and the nodes near them meet by node, once; what is found by name and by column are windows inside of that.
    """
    of = lambda df, rule: df.select(F.col("node_id").alias("node"), "col", "source", F.lit(rule).alias("rule"))
    maps = of(own, 0).unionByName(of(loaded, 1)).where("node is not null")
    near = _near(maps.where("source like '%.%'").select("node").distinct(), flow, nodes)
    both = spread(maps.unionByName(near, allowMissingColumns=True), "node")
    object_ = F.when(F.col("source").like("%.%"), F.expr("substr(source, 1, length(source) - instr(reverse(source), '.'))"))
    names = F.when(F.col("rule").isNull(), F.array_compact(F.array_distinct(F.array(F.lower("qualified"), F.lower("name"))))).otherwise(F.array(object_))
    both = both.select("*", F.explode(names).alias("object"))
    of_name, of_column = Window.partitionBy("node", "object"), Window.partitionBy("node", "col")
    named = F.when(F.col("rule").isNull(), F.struct("up", "qualified"))
    hit = both.withColumn("hit", F.min(named).over(of_name)).where("rule is not null")
    first = hit.withColumn("least", F.min("rule").over(of_column)).where("rule = least")
    to = F.when(F.col("object").isNotNull(), F.substring_index("source", ".", -1))
    return written(first.select("node", "col", "source", "object", to.alias("to"), F.when(F.col("object").isNotNull(), F.col("hit")).alias("hit")).distinct())


def _links(maps: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, col, up, to, text): where each column goes on to (up, to), or the text in which a trace ends there; laid."""
    held = maps.select(F.col("node").alias("up"), F.col("col").alias("to"), F.lit(True).alias("held")).distinct()
    to = maps.where("hit is not null").select("node", "col", "hit.up", "to", "hit.qualified").join(held, ["up", "to"], "left")
    on = F.col("held").isNotNull()
    out = to.select("node", "col", F.when(on, F.col("up")).alias("up"), F.when(on, F.col("to")).alias("to"), F.when(~on, F.concat_ws(".", "qualified", "to")).alias("text"))
    end = lambda df, text: df.select("node", "col", text.alias("text"))
    out = out.unionByName(end(maps.where("hit is null and object is not null"), F.concat(F.col("object"), F.lit("."), F.col("to"), F.lit(" (unresolved node)"))), allowMissingColumns=True)
    none = maps.where("source is null").join(nodes.select(F.col("id").alias("node"), "qualified"), "node")
    return laid(out.unionByName(end(none, F.concat_ws(".", "qualified", "col")), allowMissingColumns=True), "node", "col")


def column_sources(roots: DataFrame, own: DataFrame, loaded: DataFrame, flow: DataFrame, nodes: DataFrame) -> DataFrame:
    """(root, col, source): the columns in which the trace of each root (root, col) ends.

    An object's column goes on to what its own map ``own`` (node_id, col, source) says; without one, to the union of what
    everything that loads it says, ``loaded`` (node_id, col, source, any number of writers). A source ``object.column`` means the
    least id of those nodes (id, name, qualified) up to two steps upstream whose qualified or bare name is its object; none:
    the trace ends there, marked "(unresolved node)". A column without sources is an end. Cycles end, since a root meets each
    column once. What a source means is found for all maps at once, so a round is a join of the front with links that lie by
    (node, column), and one of what is new with what was met; ends are links' texts and are never walked to.
    """
    maps = _resolved(own, loaded, flow, nodes)
    links = _links(maps, nodes)
    key = ["root", "of", "node", "col"]
    met, level = Laid(roots.sparkSession, *key), 0
    met.add(met.deal(roots.select("root", F.col("col").alias("of"), F.col("root").alias("node"), F.lower("col").alias("col"), F.lit(0).alias("depth")).distinct()))
    front = lambda: met.rows().where(F.col("depth") == level).select(*key)
    alone = front().join(maps.select("node", "col").distinct(), ["node", "col"], "left_anti").join(nodes.select(F.col("id").alias("node"), "qualified"), "node")
    ends = [written(alone.select("root", "of", F.concat_ws(".", "qualified", "col").alias("source")))]
    while not front().isEmpty():
        step = written(front().join(links.hint("merge"), ["node", "col"]).select("root", "of", "up", "to", "text"))
        ends.append(step.where("text is not null").select("root", "of", F.col("text").alias("source")))
        new = step.where("text is null").select("root", "of", F.col("up").alias("node"), F.col("to").alias("col")).distinct()
        level += 1
        met.add(new.join(met.rows().select(*key).hint("merge"), key, "left_anti").withColumn("depth", F.lit(level)))
    met.done()
    out = ends[0]
    for e in ends[1:]:
        out = out.unionByName(e)
    return out.select("root", F.col("of").alias("col"), "source").distinct()
