"""Workflows, task manifests and projects from files: JSON bundles, JSON schemas, TOML projects; and root frames."""

from __future__ import annotations

import hashlib
import json
import tomllib
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ssaflow.operators.control import RUNTIMES, TRUST, normal_pool
from ssaflow.operators.tasks import Registry
from ssaflow.plans import ir

TASK_KINDS = ("single", "batch", "stream", "direct")


@dataclass(frozen=True)
class Manifest:
    """What is known about a task besides its code."""

    task_id: str
    version: str
    task_kind: str
    trust: str
    runtime: str
    requires_gpu: bool = False
    resource_class: str = "cpu.small"
    capabilities: list[str] = field(default_factory=lambda: ["cpu"])
    input_arity: int = 0
    output_arity: int = 0
    input_schema: object = None
    output_schema: object = None
    checksum: str = ""
    abi_version: str = "1"
    build_toolchain: str = ""
    created_at: str = ""

    def __post_init__(self) -> None:
        for value, known in ((self.task_kind, TASK_KINDS), (self.trust, TRUST), (self.runtime, RUNTIMES)):
            if value not in known:
                raise ValueError(f"{value!r} isn't one of {', '.join(known)}")

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    def problems(self) -> list[str]:
        """The rules that the manifest breaks."""
        untrusted, wasm = self.trust == "untrusted", self.runtime == "wasm"
        rules = (("an untrusted task needs the wasm runtime", untrusted and not wasm), ("the wasm runtime is for untrusted tasks", wasm and not untrusted), ("a gpu task needs the native runtime", self.requires_gpu and wasm), ("a gpu task can't be untrusted", self.requires_gpu and untrusted))
        return [text for text, broken in rules if broken]

    def pool(self) -> str:
        return normal_pool("gpu" if self.requires_gpu else "wasm" if self.trust == "untrusted" else self.trust)


def load_manifest(text: str) -> Manifest:
    return Manifest(**json.loads(text))


def ddl_of(schema) -> str:
    """The type of a JSON schema; what it leaves open is a variant."""
    kind = schema.get("type") if isinstance(schema, dict) else None
    plain = {"integer": "bigint", "boolean": "boolean", "string": "string", "number": "double", "null": "void"}
    if kind in plain:
        return plain[kind]
    if kind == "array":
        items = schema.get("items")
        if isinstance(items, list):
            return "struct<" + ",".join(f"_{k}:{ddl_of(s)}" for k, s in enumerate(items)) + ">"
        return f"array<{ddl_of(items)}>"
    if kind == "object" and schema.get("properties"):
        return "struct<" + ",".join(f"`{n}`:{ddl_of(s)}" for n, s in schema["properties"].items()) + ">"
    return "variant"


@dataclass(frozen=True)
class Bundle:
    """A workflow with its version and those of its tasks."""

    id: str
    version: str
    ir: ir.Workflow
    task_versions: dict[str, str]

    def to_json(self) -> str:
        return json.dumps({"id": self.id, "version": self.version, "ir": ir.to_dict(self.ir), "task_versions": self.task_versions}, indent=2)


def load_bundle(text: str) -> Bundle:
    d = json.loads(text)
    return Bundle(d["id"], d["version"], ir.from_dict(d["ir"]), dict(d.get("task_versions", {})))


def bundle(wf: ir.Workflow, version: str, versions: dict[str, str]) -> Bundle:
    """A bundle with the versions of the tasks that the workflow calls; one that isn't known is an error."""
    missing = [t for t in wf.task_ids() if t not in versions]
    if missing:
        raise KeyError(f"no version of {', '.join(missing)}")
    return Bundle(wf.name, version, wf, {t: versions[t] for t in wf.task_ids()})


@dataclass(frozen=True)
class Project:
    name: str
    tasks: dict[str, Manifest]
    workflows: dict[str, str]
    registries: dict[str, str]
    out_dir: str


def load_project(path: str) -> Project:
    """A project's TOML: [project], [tasks.NAME], [workflows.NAME], [registries.NAME] and [build]."""
    doc = tomllib.loads(Path(path).read_text(encoding="utf-8"))
    root = Path(path).parent
    tasks = {}
    for name, entry in doc.get("tasks", {}).items():
        known = {k: entry[k] for k in ("version", "trust", "runtime", "requires_gpu", "resource_class", "capabilities", "input_arity", "output_arity", "input_schema", "output_schema") if k in entry}
        tasks[name] = Manifest(task_id=name, task_kind=entry["kind"], **known)
    workflows = {n: e["version"] for n, e in doc.get("workflows", {}).items() if n != "export"}
    registries = {n: e["index"] for n, e in doc.get("registries", {}).items()}
    return Project(doc.get("project", {}).get("name", ""), tasks, workflows, registries, str(root / doc.get("build", {}).get("out_dir", "dist")))


def build(project: Project, workflows: dict[str, ir.Workflow]) -> list[str]:
    """Write manifests and bundles of a project's workflows below its output folder; the paths."""
    out = Path(project.out_dir)
    out.mkdir(parents=True, exist_ok=True)
    paths = []
    for name, m in sorted(project.tasks.items()):
        body = m.to_json()
        path = out / f"{name}.manifest.json"
        path.write_text(json.dumps(json.loads(body) | {"checksum": hashlib.sha256(body.encode()).hexdigest()}), encoding="utf-8")
        paths.append(str(path))
    versions = {n: m.version for n, m in project.tasks.items()}
    for name, version in sorted(project.workflows.items()):
        path = out / f"{name}.workflow.json"
        path.write_text(bundle(workflows[name], version, versions).to_json(), encoding="utf-8")
        paths.append(str(path))
    return paths


def unknown_tasks(wf: ir.Workflow, registry: Registry) -> list[str]:
    return [t for t in wf.task_ids() if t not in registry.tasks]


def root_frame(spark: SparkSession, path: str | None = None, kind: str = "parquet", **options) -> DataFrame:
    """The contexts that a run starts with: one empty row, or the rows of files in any of Spark's formats."""
    return spark.range(1).select() if path is None else spark.read.format(kind).options(**options).load(path)
