"""The commands of a client: parse, graph, analyse, views, store."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor, TimeoutError
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovemap.cluster import cut
from grovemap.operators import filetree, graph, lod, report
from grovemap.operators.graph import Graph
from grovemap.sources.files import scan, to_graph
from grovemap.sources.parse import parse_files

Progress = Callable[[str, float], None]


class Session:
    """One opened code base. progress: called with a stage's name and the share done."""

    def __init__(self, spark: SparkSession, progress: Progress | None = None):
        self.spark, self._tell = spark, progress or (lambda stage, share: None)
        self.graph: Graph | None = None
        #: Nodes that expand_node has opened and collapse_node has not closed again.
        self.expanded: set[str] = set()
        self.errors: DataFrame | None = None
        self._files: DataFrame | None = None
        self._snapshot: lod.Snapshot | None = None

    def parse_codebase(self, root: str, ignore: list[str] = ()) -> Graph:
        self._tell("scan", 0.0)
        parsed = parse_files(scan(self.spark, root, ignore))
        self._files, self.errors = parsed.select("path"), parsed.filter("error IS NOT NULL").select("path", "error")
        self.graph, self._snapshot = to_graph(parsed), None
        self._tell("graph", 1.0)
        return self.graph

    def open(self, g: Graph) -> Session:
        self.graph, self._snapshot = g, None
        return self

    def _need(self) -> Graph:
        if self.graph is None:
            raise RuntimeError("no code base is open")
        return self.graph

    def generate_graph(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Nodes, links and totals as a client shows them."""
        g = self._need()
        return graph.payload_nodes(g), graph.triplets(g).select("src_id", "dst_id", "edge_type", "weight"), graph.payload_stats(g)

    def file_tree(self) -> DataFrame:
        paths = self._files if self._files is not None else self._need().nodes.selectExpr("file_path AS path").filter("path IS NOT NULL")
        return filetree.ordered(filetree.tree(paths))

    def analyze_with_metrics(self, communities: DataFrame | None = None) -> DataFrame:
        return report.client_metrics(self._need(), communities)

    def run_metrics(self, names: list[str] | None = None, seconds: float | None = None) -> tuple[dict[str, DataFrame], dict[str, str]]:
        """The table of each measure, written in the shared folder side by side, and the errors of those that failed or took longer than `seconds`; their jobs are cancelled."""
        g, results, errors = self._need(), {}, {}
        names = names or list(report.METRICS)

        def work(name: str, tag: str) -> DataFrame:
            self.spark.addTag(tag)
            return cut(report.METRICS[name](g), name)

        pool = ThreadPoolExecutor(max(1, len(names)))
        waiting = {n: (tag := f"metric-{uuid4().hex}", pool.submit(work, n, tag)) for n in names}
        for k, (name, (tag, job)) in enumerate(waiting.items(), 1):
            try:
                results[name] = job.result(seconds)
            except TimeoutError:
                self.spark.interruptTag(tag)
                errors[name] = "timeout"
            except Exception as e:
                errors[name] = f"{type(e).__name__}: {e}"
            self._tell(name, k / len(names))
        pool.shutdown(wait=False, cancel_futures=True)
        return results, errors

    def snapshot(self) -> lod.Snapshot:
        if self._snapshot is None:
            self._snapshot = lod.snapshot(self._need())
        return self._snapshot

    def get_graph_at_lod(self, level: int) -> tuple[DataFrame, DataFrame]:
        return lod.view(self.snapshot(), level)

    def expand_node(self, node_id: str, level: int) -> tuple[DataFrame, DataFrame]:
        self.expanded.add(node_id)
        return lod.expand(self.snapshot(), node_id, level)

    def collapse_node(self, node_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Ids of nodes and of edges to take away, and the bundled edges to bring back. What was opened inside counts as closed too."""
        nodes, edges = lod.collapse(self.snapshot(), node_id)
        inside = nodes.filter(F.col("id").isin([*self.expanded, ""])).collect() if self.expanded else []
        self.expanded -= {node_id, *(r["id"] for r in inside)}
        return nodes, edges, lod.bundles_of(self.snapshot(), node_id)

    def save_graph(self, path: str) -> None:
        """Idempotent: a second save takes the place of the first."""
        g = self._need()
        g.nodes.dropDuplicates(["ix"]).write.mode("overwrite").parquet(f"{path}/nodes")
        g.edges.dropDuplicates(["eix"]).write.mode("overwrite").parquet(f"{path}/edges")

    def get_saved_graph(self, path: str) -> Graph:
        read = self.spark.read
        return self.open(Graph(read.schema(graph.NODES).parquet(f"{path}/nodes"), read.schema(graph.EDGES).parquet(f"{path}/edges")))._need()

    def reset(self) -> None:
        self.graph = self.errors = self._files = self._snapshot = None
        self.expanded = set()
