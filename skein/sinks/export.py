"""The graph on disk: Parquet tables, one JSON file with all of it, a page with the best connected part and a report."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import community, graph

#: A page draws so many nodes and edges; it says how many it leaves out. The JSON file and the tables hold all.
SHOWN_NODES, SHOWN_EDGES = 5_000, 20_000


def write_tables(nodes: DataFrame, edges: DataFrame, out: str) -> None:
    """Through Spark, so any store works; written aside and swapped in, as they may be read while this runs."""
    spark = nodes.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = lambda name: jvm.org.apache.hadoop.fs.Path(name)
    for name, df in (("nodes", nodes), ("edges", edges)):
        df.write.mode("overwrite").parquet(f"{out}/{name}.new")
    for name in ("nodes", "edges"):
        fs = path(out).getFileSystem(conf)
        fs.delete(path(f"{out}/{name}"), True)
        fs.rename(path(f"{out}/{name}.new"), path(f"{out}/{name}"))


def read_tables(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{out}/nodes"), spark.read.parquet(f"{out}/edges")


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def graph_dict(nodes: DataFrame, edges: DataFrame) -> dict:
    """Node-link form of what a page shows: the SHOWN_NODES best connected nodes, and the first SHOWN_EDGES edges among them."""
    from skein.operators.traverse import induced_edges

    best = nodes.join(graph.degrees(edges), "id", "left").orderBy(F.desc_nulls_last("degree"), "seq").limit(SHOWN_NODES)
    rows = [r.asDict(recursive=True) for r in best.collect()]
    kept = induced_edges(edges, best).orderBy("seq").limit(SHOWN_EDGES)
    links = [r.asDict(recursive=True) for r in graph.keyed_edges(kept).orderBy("seq").collect()]
    left_out = {"nodes": nodes.count() - len(rows), "edges": edges.count() - len(links)}
    return {"directed": True, "multigraph": True, "graph": {"left_out": left_out}, "nodes": rows, "edges": links}


def write_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """The whole graph in node-link form, a row at a time: memory holds a partition's rows, however large the graph is."""
    parts = (("nodes", nodes.orderBy("seq")), ("edges", graph.keyed_edges(edges).orderBy("seq")))
    with open(path, "w", encoding="utf-8") as out:
        out.write('{"directed": true, "multigraph": true, "graph": {}')
        for name, rows in parts:
            lines = rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("line"))
            for k, row in enumerate(lines.toLocalIterator()):
                out.write(f', "{name}": [\n' if not k else ",\n")
                out.write(row["line"])
            out.write("]" if rows.take(1) else f', "{name}": []')
        out.write("}\n")


def from_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a node-link file."""
    whole = spark.read.option("multiLine", True).json(path)
    seq = lambda df: df.withColumn("seq", F.monotonically_increasing_id())
    nodes = whole.select(F.explode("nodes").alias("n")).select("n.*")
    edges = whole.select(F.explode("edges").alias("e")).select("e.*")
    return (nodes if "seq" in nodes.columns else seq(nodes)), (edges if "seq" in edges.columns else seq(edges))


_PAGE = """<!doctype html><meta charset="utf-8"><title>Graph</title>
<style>body{margin:0;font:14px sans-serif}#side{position:fixed;left:0;top:0;width:240px;height:100%%;overflow:auto;padding:8px;background:#f6f6f6}canvas{margin-left:256px}label{display:block}</style>
<div id="side"><input id="find" placeholder="Find"><p id="left"></p><div id="groups"></div></div><canvas id="view"></canvas>
<script id="graph" type="application/json">%s</script><script id="info" type="application/json">%s</script>
<script>
const read=i=>JSON.parse(document.getElementById(i).textContent),g=read("graph"),info=read("info"),view=document.getElementById("view"),pen=view.getContext("2d");
view.width=innerWidth-256;view.height=innerHeight;const hidden=new Set(),degree={};
g.edges.forEach(e=>{degree[e.source]=(degree[e.source]||0)+1;degree[e.target]=(degree[e.target]||0)+1});
const at={};g.nodes.forEach((n,i)=>{const r=Math.sqrt((i+1)/g.nodes.length)*Math.min(view.width,view.height)/2.1,a=i*2.39996;at[n.id]=[view.width/2+r*Math.cos(a),view.height/2+r*Math.sin(a)]});
const group=n=>String(n.community??0),size=n=>Math.min(10+4*(degree[n.id]||0),45)/5;
function draw(){const q=document.getElementById("find").value.toLowerCase();pen.clearRect(0,0,view.width,view.height);const shown=new Set(g.nodes.filter(n=>!hidden.has(group(n))).map(n=>n.id));
pen.strokeStyle="#ccc";g.edges.forEach(e=>{if(shown.has(e.source)&&shown.has(e.target)){pen.beginPath();pen.moveTo(...at[e.source]);pen.lineTo(...at[e.target]);pen.stroke()}});
g.nodes.forEach(n=>{if(!shown.has(n.id))return;const hit=q&&n.label.toLowerCase().includes(q);pen.fillStyle=hit?"#000":(info[group(n)]||{}).color||"#888";pen.beginPath();pen.arc(...at[n.id],size(n),0,7);pen.fill();if(hit||g.nodes.length<80)pen.fillText(n.label,at[n.id][0]+6,at[n.id][1])})}
for(const [k,v] of Object.entries(info)){const l=document.createElement("label"),c=document.createElement("input");c.type="checkbox";c.checked=true;c.onchange=()=>{c.checked?hidden.delete(k):hidden.add(k);draw()};l.append(c,v.label+" ("+v.count+")");l.style.color=v.color;document.getElementById("groups").append(l)}
const left=(g.graph||{}).left_out||{};if(left.nodes||left.edges)document.getElementById("left").textContent="Not shown: "+(left.nodes||0)+" nodes, "+(left.edges||0)+" edges. graph.json has all.";
document.getElementById("find").oninput=draw;draw();
</script>
"""


def _json(value) -> str:
    """JSON that no text in it can end the script element of."""
    return json.dumps(value, ensure_ascii=False, default=str).replace("</", "<\\/").replace("<!--", "<\\!--")


def community_info(nodes: DataFrame, edges: DataFrame, provider=None) -> dict:
    """{community: label, count, color} of the SHOWN_NODES largest communities."""
    from skein.sources.providers import group_name

    if "community" not in nodes.columns:
        nodes = nodes.withColumn("community", F.lit(None).cast("long"))
    largest = lambda of: community.representatives(of, edges).orderBy(F.desc("n_members"), "community").limit(SHOWN_NODES).collect()
    rows = largest(nodes)
    shown = {r["community"]: list(r["top_labels"]) for r in rows}
    if provider is not None and "force_local" in nodes.columns and not getattr(provider, "local", False):
        # labels of files that must not leave the machine aren't sent
        shown = {r["community"]: list(r["top_labels"]) for r in largest(nodes.filter(~F.coalesce("force_local", F.lit(False))))}
    named = lambda r: group_name(provider, shown.get(r["community"], [])) if r["n_members"] > 1 else None
    return {str(r["community"]): {"label": named(r) or r["label"], "count": r["n_members"], "color": r["color"]} for r in sorted(rows, key=lambda r: r["community"])}


def report_lines(nodes: DataFrame, edges: DataFrame) -> list[str]:
    out = ["# Graph", "", f"- Nodes: {nodes.count()}", f"- Edges: {edges.count()}", "", "## By modality"]
    out += [f"- {r['modality']}: {r['n_nodes']}" for r in graph.modality_counts(nodes).orderBy("modality").collect()]
    out += ["", "## Best connected"]
    return out + [f"- {r['label']} ({r['degree']} edges)" for r in graph.top_degrees(nodes, edges).collect()]


def export(nodes: DataFrame, edges: DataFrame, out: str, provider=None) -> None:
    """Tables, then graph.json, graph.html and REPORT.md on the driver's disk."""
    Path(out).mkdir(parents=True, exist_ok=True)
    write_tables(nodes, edges, out)
    nodes, edges = read_tables(nodes.sparkSession, out)
    shown, info = graph_dict(nodes, edges), community_info(nodes, edges, provider)
    write_json(nodes, edges, str(Path(out, "graph.json")))
    Path(out, "graph.html").write_text(_PAGE % (_json(shown), _json(info)), encoding="utf-8")
    Path(out, "REPORT.md").write_text("\n".join(report_lines(nodes, edges)) + "\n", encoding="utf-8")
