"""python -m otreelake.visualize PATH: a table's tree of cubes as JSON or as a page with a drawing.

    python -m otreelake.visualize /data/line -r 1 -f 0.02 -o tree.html

Cubes that a sample of the fraction touches are filled; what the sample reads is told below. It reads the log of a table on a local or mounted file system, without Spark.
"""

from __future__ import annotations

import argparse
import html
import json
from collections.abc import Iterator
from dataclasses import dataclass

from .functions.cubes import Cube
from .functions.weights import from_fraction
from .sources.datasource import local_log
from .sources.log import Revision, Snapshot


@dataclass
class Node:
    cube: Cube
    least: int
    greatest: int
    elements: int
    blocks: int
    x: float = 0.0


def nodes_of(snapshot: Snapshot, revision: Revision) -> dict[Cube, Node]:
    """The stored cubes, in pre-order."""
    found: dict[Cube, Node] = {}
    d = len(revision.transformers)
    for f in snapshot.files_of(revision.id):
        for b in f.blocks:
            cube = Cube.parse(d, b.cube)
            n = found.setdefault(cube, Node(cube, b.min_weight, b.max_weight, 0, 0))
            n.least, n.greatest, n.elements, n.blocks = min(n.least, b.min_weight), min(n.greatest, b.max_weight), n.elements + b.elements, n.blocks + 1
    return dict(sorted(found.items(), key=lambda x: x[0].order_key()))


def edges_of(nodes: dict[Cube, Node]) -> Iterator[tuple[Cube, Cube]]:
    for cube in nodes:
        if cube.depth and (parent := cube.parent()) in nodes:
            yield parent, cube


def reading(snapshot: Snapshot, revision: Revision, fraction: float) -> dict[str, int]:
    """Files, rows and bytes that a sample touches, and all there are."""
    limit = from_fraction(fraction)
    files = snapshot.files_of(revision.id)
    hit = [f for f in files if any(b.min_weight < limit for b in f.blocks)]
    return {"files_read": len(hit), "files": len(files), "rows_read": sum(f.elements for f in hit), "rows": sum(f.elements for f in files), "bytes_read": sum(f.size for f in hit), "bytes": sum(f.size for f in files)}


def as_json(snapshot: Snapshot, revision: Revision, fraction: float) -> str:
    nodes = nodes_of(snapshot, revision)
    limit = from_fraction(fraction)
    listed = [{"id": c.string(), "depth": c.depth, "minWeight": n.least, "maxWeight": n.greatest, "elements": n.elements, "sampled": n.least < limit} for c, n in nodes.items()]
    return json.dumps({"revision": revision.id, "nodes": listed, "edges": [{"source": a.string(), "target": b.string()} for a, b in edges_of(nodes)], "sample": {"fraction": fraction} | reading(snapshot, revision, fraction)})


def laid_out(nodes: dict[Cube, Node]) -> float:
    """Gives each leaf a place of its own and each inner cube the middle of its children; returns the width."""
    inner: dict[Cube, list[Node]] = {}
    for parent, cube in edges_of(nodes):
        inner.setdefault(parent, []).append(nodes[cube])
    at = 0.0
    for cube, n in nodes.items():
        if cube not in inner:
            n.x, at = at, at + 1
    for cube in sorted(inner, key=lambda c: -c.depth):
        nodes[cube].x = sum(n.x for n in inner[cube]) / len(inner[cube])
    return at


def as_page(snapshot: Snapshot, revision: Revision, fraction: float, step: int = 26, level: int = 80) -> str:
    """A page that stands alone, with the tree as SVG; a cube's numbers show where the pointer rests."""
    nodes = nodes_of(snapshot, revision)
    width, limit = laid_out(nodes), from_fraction(fraction)
    place = lambda n: (20 + n.x * step, 30 + n.cube.depth * level)
    lines = [f'<line x1="{x:.1f}" y1="{y}" x2="{u:.1f}" y2="{v}"/>' for a, b in edges_of(nodes) for (x, y), (u, v) in [(place(nodes[a]), place(nodes[b]))]]
    most = max((n.elements for n in nodes.values()), default=1) or 1
    dots = []
    for cube, n in nodes.items():
        x, y = place(n)
        told = html.escape(f"{cube.string() or 'root'}: {n.elements} rows in {n.blocks} blocks, weights {n.least} to {n.greatest}")
        dots.append(f'<circle cx="{x:.1f}" cy="{y}" r="{3 + 8 * (n.elements / most) ** 0.5:.1f}" class="{"hit" if n.least < limit else "rest"}"><title>{told}</title></circle>')
    height = 60 + level * max((c.depth for c in nodes), default=0)
    told = ", ".join(f"{k}: {v}" for k, v in reading(snapshot, revision, fraction).items())
    style = "line{stroke:#999}circle{stroke:#333}.hit{fill:#c60}.rest{fill:#fff}body{font-family:sans-serif}"
    return (f'<!doctype html><meta charset="utf-8"><title>revision {revision.id}</title><style>{style}</style><h1>Revision {revision.id} on {html.escape(",".join(revision.columns))}</h1>'
            f'<svg width="{40 + width * step:.0f}" height="{height}">{"".join(lines)}{"".join(dots)}</svg><p>sample {fraction}: {told}</p>')  # fmt: skip


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="otreelake.visualize", description="Draws the tree of cubes of a table.")
    parser.add_argument("path")
    parser.add_argument("-r", "--revision", type=int, help="the newest without it")
    parser.add_argument("-f", "--fraction", type=float, default=0.0, help="of a sample whose cubes are filled")
    parser.add_argument("-o", "--output", help="a page is written there; without it, JSON is printed")
    given = parser.parse_args(arguments)
    snapshot = local_log(given.path).snapshot()
    if snapshot.initial:
        parser.error(f"{given.path} is not a table")
    revision = snapshot.latest if given.revision is None else snapshot.revision(given.revision)
    if given.output:
        with open(given.output, "w", encoding="utf-8") as f:
            f.write(as_page(snapshot, revision, given.fraction))
    else:
        print(as_json(snapshot, revision, given.fraction))


if __name__ == "__main__":
    main()
