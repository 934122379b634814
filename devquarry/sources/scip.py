"""Code indexes in the SCIP protobuf form, read as a graph of symbols."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Node kinds by the numbers of symbol kinds in the public protocol; symbols of other kinds are no nodes.
KINDS = {
    "class": (7, 49, 11, 33, 54, 55, 58, 53, 59), "interface": (21, 42), "function": (17, 80, 25, 9, 34), "method": (26, 66, 72, 18, 45, 76),
    "field": (15, 12, 8, 79, 41, 75), "module": (29, 30, 44, 35), "file": (16,),
}
KIND_OF = {n: kind for kind, numbers in KINDS.items() for n in numbers}
#: Languages by file ending, where a document names none.
LANGUAGES = {
    "rs": "rust", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "py": "python", "go": "go", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp",
}
NODE = "id string, kind string, name string, qualified_name string, language string, file string, start_line int, end_line int, doc_comment string"
EDGE = "src string, dst string, kind string, weight double"


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value & 0xFFFFFFFFFFFFFFFF, at
        if shift > 63:
            raise ValueError("number too long")


def fields(data: bytes):
    """Number and value (an integer, or bytes) of each field of a message; cut or unknown forms raise ValueError."""
    at = 0
    try:
        while at < len(data):
            tag, at = varint(data, at)
            form = tag & 7
            if form == 0:
                value, at = varint(data, at)
            elif form in (1, 2, 5):
                size, at = varint(data, at) if form == 2 else ({1: 8, 5: 4}[form], at)
                value, at = data[at : at + size], at + size
            else:
                raise ValueError(f"field form {form}")
            if at > len(data):
                raise ValueError("message is cut")
            yield tag >> 3, value
    except IndexError:
        raise ValueError("message is cut") from None


def message(data: bytes) -> dict[int, list]:
    out: dict[int, list] = {}
    for number, value in fields(data):
        out.setdefault(number, []).append(value)
    return out


def text(found: dict[int, list], number: int) -> str:
    return found[number][-1].decode(errors="replace") if number in found else ""


def signed(value: int) -> int:
    value &= 0xFFFFFFFF
    return value - (1 << 32) if value >> 31 else value


def numbers(found: dict[int, list], number: int) -> list[int]:
    """A repeated integer field, packed or not."""
    out = []
    for value in found.get(number, []):
        if isinstance(value, int):
            out.append(signed(value))
            continue
        at = 0
        while at < len(value):
            n, at = varint(value, at)
            out.append(signed(n))
    return out


def graph_of(document: bytes) -> tuple[list[tuple], list[tuple]]:
    """Nodes and edges of a document: its symbols, what they implement, and what is referred to after each definition."""
    found = message(document)
    path = text(found, 1)
    language = text(found, 4).lower() or LANGUAGES.get(path.rpartition(".")[2].lower(), "unknown")
    name = lambda symbol: f"scip:{language}:{symbol}"
    occurrences = [(text(o, 2), bool(numbers(o, 3) and numbers(o, 3)[-1] & 1), numbers(o, 1)) for o in map(message, found.get(2, []))]
    places: dict[str, tuple[int, int]] = {}
    for symbol, defines, span in occurrences:
        if defines and symbol not in places:
            start = max(span[0], 0) if span else 0
            places[symbol] = (start, max(span[2], 0) if len(span) >= 4 else start)
    nodes, edges = [], []
    for s in map(message, found.get(3, [])):
        symbol, kind = text(s, 1), KIND_OF.get(s[5][-1] if 5 in s else 0)
        if kind:
            parts = [p for p in symbol.translate(str.maketrans(".#()", "////")).split("/") if p]
            told = "\n".join(d.decode(errors="replace") for d in s[3]) if 3 in s else None
            nodes.append((name(symbol), kind, text(s, 6) or (parts[-1] if parts else symbol), symbol, language, path, *places.get(symbol, (0, 0)), told))
        edges += [(name(symbol), name(text(r, 1)), "Implements", 1.0) for r in map(message, s.get(4, [])) if r.get(3, [0])[-1]]
    inside = None
    for symbol, defines, _ in occurrences:
        if defines:
            inside = name(symbol)
        elif inside and symbol and name(symbol) != inside:
            edges.append((inside, name(symbol), "References", 1.0))
    return nodes, edges


def scip_documents(indexes: DataFrame) -> DataFrame:
    """path of the index, place and bytes of each document of index files (path, content); a broken index raises."""

    def rows(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                for place, data in enumerate(v for n, v in fields(bytes(content)) if n == 2):
                    yield pd.DataFrame({"path": [path], "place": [place], "document": [data]})

    return indexes.filter("content is not null").select("path", "content").mapInPandas(rows, "path string, place long, document binary")


def scip_graph(indexes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of index files (path, content); an index is split by one task, its documents are dealt to all.

    Symbols of a kind that the graph lacks are no nodes, though edges may name them. Repeated references are repeated edges.
    """
    documents = scip_documents(indexes).repartition("path", "place")

    def taken(which: int, schema: str):
        columns = [c.split()[0] for c in schema.split(", ")]

        def rows(batches):
            for pdf in batches:
                for data in pdf["document"]:
                    yield pd.DataFrame(graph_of(bytes(data))[which], columns=columns)

        return documents.mapInPandas(rows, schema)

    return taken(0, NODE), taken(1, EDGE)


def read_scip(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.scip").load(folder)
    return scip_graph(files.select(F.col("path"), "content"))
