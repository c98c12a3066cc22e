"""Per-file table functions: each file becomes tagged rows (schemas.FACTS), on the executors, an Arrow batch at a time."""

from __future__ import annotations

import re
import struct
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein import schemas
from skein.shared import ship
from skein.sources import scanner


#: Rows of small files leave a task so many at a time.
ROWS = 5_000


def slug(text: str) -> str:
    return re.sub("[^a-z0-9]+", "_", unicodedata.normalize("NFKC", text).lower()).strip("_") or "x"


def make_id(*parts: str) -> str:
    return "_".join(slug(p) for p in parts if p)


class Facts:
    """Collects a file's rows in order."""

    def __init__(self, rel_path: str):
        self.rel_path, self.rows = rel_path, []

    def _add(self, **values):
        self.rows.append({"rel_path": self.rel_path, "pos": len(self.rows), **values})

    def node(self, node_id: str, label: str, modality: str, at: str | None = None, **metadata):
        self._add(kind="node", id=node_id, label=label, modality=modality, source_location=at, metadata=[(k, str(v)) for k, v in metadata.items()])

    def edge(self, source: str, target: str, relation: str, confidence: str, at: str | None = None, context: str | None = None):
        self._add(kind="edge", source=source, target=target, relation=relation, confidence=confidence, source_location=at, context=context)

    def other(self, kind: str, **values):
        self._add(kind=kind, **values)


def code_facts(rel_path: str, text: str, language: str) -> Facts:
    """A file's definitions (node), what holds them (edge), calls inside the file (edge), calls and imports that
    other files may answer (call, import), its namespace, and 'incomplete' where it can't be read."""
    facts, file_id = Facts(rel_path), make_id(rel_path)
    if language not in scanner.LANGUAGES:
        facts.other("incomplete")
        return facts
    name = rel_path.rsplit("/", 1)[-1]
    try:
        found, namespace = scanner.events(text, language)
    except (SyntaxError, ValueError, RecursionError) as error:
        facts.node(file_id, name, "code", None, error=f"{language}: {error}")
        facts.other("incomplete")
        return facts
    facts.node(file_id, name, "code", "L1")
    if namespace:
        facts.other("namespace", name=namespace, id=file_id)
    known: dict[str, str] = {}
    used = {file_id}

    def own_id(label: str) -> str:
        wanted = candidate = make_id(rel_path, label)
        n = 2
        while candidate in used:
            candidate, n = f"{wanted}_{n}", n + 1
        used.add(candidate)
        return candidate

    def define(label: str, shown: str, parent: str, at: str) -> str:
        new = own_id(label)
        facts.node(new, shown, "code", at)
        facts.edge(parent, new, "contains", schemas.EXTRACTED, at)
        return new

    scopes: list[tuple[int, str]] = []  # (end, id), innermost last
    for kind, label, line, start, end, extra in found:
        while scopes and start >= scopes[-1][0]:
            scopes.pop()
        parent, at = scopes[-1][1] if scopes else file_id, f"L{line}"
        if kind == "reopen":
            label = label.split("<")[0]
            known[label] = known.get(label) or define(label, label, parent, at)
            scopes.append((end, known[label]))
        elif kind == "class":
            known[label] = define(label, label, parent, at)
            scopes.append((end, known[label]))
        elif kind == "function":
            if extra:  # a type outside which the function stands
                known[extra] = known.get(extra) or define(extra, extra, parent, at)
                parent = known[extra]
            known[label] = define(label, f"{label}()", parent, at)
            scopes.append((end, known[label]))
        elif kind == "import":
            facts.other("import", id=file_id, name=label, relation=extra, line=at)
        elif label in known:
            if known[label] != parent:
                facts.edge(parent, known[label], "calls", schemas.EXTRACTED, at)
        else:
            facts.other("call", id=parent, name=label, line=at)
    return facts


HEADING = re.compile(r"^(#{1,6})\s+(.+)$", re.MULTILINE)
MENTION = re.compile(r"`([A-Za-z_][A-Za-z0-9_]*)`")


def document_facts(rel_path: str, text: str, provider=None) -> Facts:
    """Headings under headings, mentions between backticks, and what the provider names (concept, relation)."""
    facts, file_id = Facts(rel_path), make_id(rel_path)
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    facts.node(file_id, rel_path.rsplit("/", 1)[-1], "document", "L1")
    above: dict[int, str] = {}
    for m in HEADING.finditer(text):
        level, title, line = len(m[1]), m[2].strip(), text.count("\n", 0, m.start()) + 1
        own, at = make_id(rel_path, title, str(line)), f"L{line}"
        facts.node(own, title, "document", at)
        facts.edge(next((above[k] for k in range(level - 1, 0, -1) if k in above), file_id), own, "contains", schemas.EXTRACTED, at)
        above = {k: v for k, v in above.items() if k < level} | {level: own}
    for m in MENTION.finditer(text):
        facts.other("mention", id=file_id, name=m[1], line=str(text.count("\n", 0, m.start()) + 1))
    if provider is not None:
        _reply(facts, file_id, provider.read_text(text[:6000]), "document", provider.name, "contains", "concept", schemas.INFERRED)
    return facts


def _reply(facts: Facts, file_id: str, reply: dict, modality: str, backend: str, relation: str, infix: str, confidence: str, **more) -> int:
    """Nodes, edges and rows (concept, relation) of a provider's reply; how many concepts it has."""
    if reply.get("_error"):
        facts.other("incomplete")
    n = 0
    for entity in reply.get("entities") or ():
        name = entity.get("name")
        if not name:
            continue
        n += 1
        own = make_id(facts.rel_path, infix, name)
        facts.node(own, name, "concept" if modality == "document" else modality, None, entity_type=entity.get("type") or "concept", backend=backend, **more)
        facts.edge(file_id, own, relation, confidence)
        facts.other("concept", id=own, name=name)
    for r in reply.get("relations") or ():
        if r.get("source") and r.get("target"):
            facts.other("relation", source=r["source"], target=r["target"], relation=r.get("relation") or "references", confidence=confidence)
    return n


def _placeholder(facts: Facts, name: str, label: str, **metadata):
    facts.node(make_id(facts.rel_path, name), label, "concept", None, **metadata)


def pdf_text(content: bytes) -> str:
    """Text of all pages; empty if it can't be read, or without a reader."""
    try:
        import io

        from pypdf import PdfReader

        return "\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(content)).pages)
    except Exception:
        return ""


def pdf_facts(rel_path: str, text: str, provider=None) -> Facts:
    facts, file_id = Facts(rel_path), make_id(rel_path)
    facts.node(file_id, rel_path.rsplit("/", 1)[-1], "pdf", "L1")
    if not text.strip():
        return facts
    if provider is None:
        _placeholder(facts, "extraction_incomplete", "[not read: no provider]", reason="no provider")
        facts.other("incomplete")
        return facts
    reply = provider.read_text(text[:6000])
    if reply.get("_error"):
        facts.other("incomplete")
    for entity in reply.get("entities") or ():
        if entity.get("name"):
            own = make_id(rel_path, entity["name"])
            facts.node(own, entity["name"], "pdf", None, entity_type=entity.get("type") or "concept", backend=provider.name)
            facts.edge(file_id, own, "contains", schemas.INFERRED)
    for r in reply.get("relations") or ():  # ends that don't exist fall away with dangling edges
        if r.get("source") and r.get("target"):
            facts.edge(make_id(rel_path, r["source"]), make_id(rel_path, r["target"]), r.get("relation") or "references", schemas.INFERRED)
    return facts


def image_size(data: bytes) -> dict:
    """width, height and format from a PNG, GIF, JPEG or WebP header; empty if it is none."""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return dict(zip(("width", "height"), struct.unpack(">II", data[16:24]), strict=True), format="PNG")
        if data[:6] in (b"GIF87a", b"GIF89a"):
            return dict(zip(("width", "height"), struct.unpack("<HH", data[6:10]), strict=True), format="GIF")
        if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            if data[12:16] == b"VP8X":
                return {"width": int.from_bytes(data[24:27], "little") + 1, "height": int.from_bytes(data[27:30], "little") + 1, "format": "WEBP"}
            if data[12:16] == b"VP8L":
                bits = int.from_bytes(data[21:25], "little")
                return {"width": (bits & 0x3FFF) + 1, "height": (bits >> 14 & 0x3FFF) + 1, "format": "WEBP"}
            return {"width": struct.unpack("<H", data[26:28])[0] & 0x3FFF, "height": struct.unpack("<H", data[28:30])[0] & 0x3FFF, "format": "WEBP"}
        if data[:2] == b"\xff\xd8":
            at = 2
            while at + 9 < len(data):
                marker, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
                if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                    height, width = struct.unpack(">HH", data[at + 5 : at + 9])
                    return {"width": width, "height": height, "format": "JPEG"}
                at += 2 + size
    except (struct.error, IndexError):
        pass
    return {}


def image_facts(rel_path: str, content: bytes, media_type: str, provider=None) -> Facts:
    facts, file_id = Facts(rel_path), make_id(rel_path)
    facts.node(file_id, rel_path.rsplit("/", 1)[-1], "image", None, **image_size(content))
    if provider is None:
        _placeholder(facts, "no_extraction", "[not read: no provider for images]")
        facts.other("incomplete")
    elif not _reply(facts, file_id, provider.read_image(content, media_type), "image", provider.name, "illustrates", "concept", schemas.INFERRED):
        _placeholder(facts, "extraction_failed", f"[nothing found by {provider.name}]")
        facts.other("incomplete")
    return facts


def video_facts(rel_path: str, content: bytes, provider=None) -> Facts:
    """Spoken segments and what key frames show. A provider without ``transcribe`` leaves the sound out."""
    facts, file_id = Facts(rel_path), make_id(rel_path)
    facts.node(file_id, rel_path.rsplit("/", 1)[-1], "video")
    transcribe = getattr(provider, "transcribe", None)
    segments = transcribe(content) if transcribe else None
    found = False
    if segments is None:
        _placeholder(facts, "no_transcript", "[sound not read: no transcription]")
        facts.other("incomplete")
    for s in segments or ():
        found = True
        at = f"{int(s['start'] // 60):02d}:{int(s['start'] % 60):02d}"
        own = make_id(rel_path, "segment", at)
        facts.node(own, s["text"][:80], "video", at)
        facts.edge(file_id, own, "contains", schemas.EXTRACTED, at)
    if segments and provider is not None:
        for entity in provider.read_text(" ".join(s["text"] for s in segments)[:6000]).get("entities") or ():
            if entity.get("name"):
                own = make_id(rel_path, entity["name"])
                facts.node(own, entity["name"], "video")
                facts.edge(file_id, own, "contains", schemas.INFERRED)
    seen: set[str] = set()
    for frame in getattr(provider, "key_frames", lambda _: ())(content):
        reply = provider.read_image(frame, "image/png")
        fresh = [e for e in reply.get("entities") or () if e.get("name") and e["name"] not in seen]
        seen |= {e["name"] for e in fresh}
        found |= bool(_reply(facts, file_id, {**reply, "entities": fresh}, "video", provider.name, "illustrates", "frame_concept", schemas.INFERRED, source="frame"))
    if not found and segments is not None:
        _placeholder(facts, "no_content_found", "[neither speech nor pictures found]")
    return facts


def file_facts(rel_path: str, modality: str, language: str | None, content: bytes, provider=None) -> Facts:
    if modality == "code":
        return code_facts(rel_path, content.decode("utf-8", "replace"), language or "")
    if modality == "document":
        return document_facts(rel_path, content.decode("utf-8", "replace"), provider)
    if modality == "pdf":
        return pdf_facts(rel_path, pdf_text(content), provider)
    if modality == "image":
        from skein.functions.text import MEDIA_TYPES

        kind = next((v for k, v in MEDIA_TYPES.items() if rel_path.lower().endswith(k)), "image/png")
        return image_facts(rel_path, content, kind, provider)
    return video_facts(rel_path, content, provider)


def extract(files: DataFrame, provider=None) -> DataFrame:
    """schemas.FACTS rows of files (rel_path, modality, language, content, and force_local if a provider may be used).

    Files that must stay local, and all files without a provider, get what can be read without one."""

    ship(files.sparkSession)
    kinds = {"pos": pa.int32(), "metadata": pa.map_(pa.string(), pa.string())}
    shape = pa.schema([(f.name, kinds.get(f.name, pa.string())) for f in schemas.FACTS.fields])

    def run(batches):
        rows = []
        for batch in batches:
            for r in batch.to_pylist():
                allowed = None if r.get("force_local", True) else provider
                rows += file_facts(r["rel_path"], r["modality"], r["language"], r["content"], allowed).rows
                if len(rows) >= ROWS:
                    yield from pa.Table.from_pylist(rows, shape).to_batches()
                    rows = []
        yield from pa.Table.from_pylist(rows, shape).to_batches()

    own = [c for c in ("rel_path", "modality", "language", "content", "force_local") if c in files.columns]
    return files.select(*own).mapInArrow(run, schemas.FACTS)


def split_facts(facts: DataFrame, file_order: DataFrame) -> dict[str, DataFrame]:
    """nodes, edges, calls, imports, namespaces, mentions, concepts, relations, incomplete. file_order: rel_path, file_seq."""
    f = facts.join(file_order, "rel_path").withColumn("seq", F.col("file_seq") * F.lit(1 << 24) + F.col("pos"))
    kind = lambda k: f.filter(F.col("kind") == k)
    return {
        "nodes": kind("node").select("id", "label", "modality", F.col("rel_path").alias("source_file"), "source_location", "metadata", "seq"),
        "edges": kind("edge").select("source", "target", "relation", "confidence", F.col("rel_path").alias("source_file"), "source_location", "context", "seq"),
        "calls": kind("call").select(F.col("id").alias("caller_id"), F.col("name").alias("callee_name"), F.col("rel_path").alias("source_file"), "line", "seq"),
        "imports": kind("import").select(F.col("id").alias("source_id"), F.col("name").alias("module"), "relation", F.col("rel_path").alias("source_file"), "line", "seq"),
        "namespaces": kind("namespace").select(F.col("name").alias("namespace"), "id"),
        "mentions": kind("mention").select("rel_path", F.col("id").alias("file_id"), "name", "line", "pos"),
        "concepts": kind("concept").select("rel_path", F.col("id").alias("concept_id"), "name", "pos"),
        "relations": kind("relation").select("rel_path", F.col("source").alias("source_name"), F.col("target").alias("target_name"), "relation", "confidence"),
        "incomplete": kind("incomplete").select("rel_path").distinct(),
    }
