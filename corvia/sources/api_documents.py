"""API documents from YAML: parsing, validation by schema version, projection to the vector table's columns."""

from __future__ import annotations

import datetime
import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvia.functions.text import display_api_name, normalized_api_name, sha256, version_of_namespace
from corvia.operators.state import reject_duplicates

# The shape of each schema version. A shape is a kind of value, a list of one shape, or a mapping of exactly
# these fields; "text!" must not be blank, "ai" is {value, is_ai}, "any" is not looked at. Version 1.0 may have more fields.
VERSIONS = ("1.0", "2.0", "2.1")
FLAT = {"chunk_id": "text!", "name": "text!", "namespace": "text!", "language": "text!", "category": "text!", "title": "text!", "layman_explanation": "text!", "raw": "any", "body_md": "text"}
FLAT_LISTS = ("product_support", "signatures", "related")
FLAT_TEXTS = ("description", "params_md", "returns", "headers", "constraints_md", "constraints_summary", "examples", "notes_md")
CONTRACT = {"type": "any", "description": "any", "possible_values": ["text"], "error_conditions": ["text"]}
RAW = {"source_path": "any", "source_url": "any", "source_heading": "any", "source_node": "any", "schema_version": "any", "extracted_by": "any", "extraction_status": "any", "pending_fields": ["text"], "extraction_notes": ["text"]}
DOCUMENT = {
    "chunk_id": "any", "name": "any", "qualified_name": "any", "namespace": "any", "version": "any", "module": "any", "language": "any", "category": "any", "title": "any", "description": "any",
    "summary": "any", "layman_explanation": "any", "signature": "any", "signatures": ["any"], "template_parameters": ["any"], "parameters": ["any"], "params_md": "any", "returns": "any",
    "return_contract": CONTRACT, "returns_md": "any", "constraints": ["any"], "constraints_md": "any", "product_support": ["any"], "examples": ["text"], "negative_examples": ["text"],
    "related": ["any"], "deprecated": "any", "deprecation_note": "any", "body_md": "any", "raw": RAW,
}
PACKAGE = {
    "schema_version": "any", "source": {"source_path": "any", "source_url": "any", "source_revision": "any", "content_hash": "any"}, "source_markdown": "text", "documents": [DOCUMENT],
    "unresolved_sections": [{"heading": "any", "content_md": "any", "reason": "any"}], "validation": {"status": "any", "errors": ["text"], "warnings": ["text"]},
}
ITEM = {"name": "text", "type": "text", "description": "text", "is_ai": "flag"}
USE = {
    "summary": "ai", "category": "ai", "description": "ai", "product_support": [{"product": "text", "supported": "flag", "is_ai": "flag"}], "prerequisites": ["ai"],
    "function_details": {"input_parameters": [ITEM], "output_parameters": [ITEM], "signature": "ai"}, "data_structure": {"fields": [ITEM]}, "examples": ["ai"],
}
NESTED_PACKAGE = {
    "schema_version": "any", "uuid": "none", "source": {"source_path": "any", "source_url": "any", "content_hash": "text!", "source_markdown": "text", "preprocess_markdown": "text", "resources": ["any"]},
    "documents": [{"name": "text!", "namespace": "text!", "version": "text!", "language": "text!", "use": USE}],
}
RESOURCE = {"image": {"resolved_uri": "any", "alt": "ai", "title": "ai"}, "link": {"resolved_uri": "any", "anchor_text": "ai", "title": "ai", "criticality": "any"}}
LEVELS = ("low", "medium", "high")
STATUSES = ("complete", "incomplete")
CATEGORIES = ("function", "data_structure")
MOST_DESCRIPTION = 300
#: Bytes that one stored document may have.
MOST_STORED = 16 * 1024 * 1024


def load_unique(text: str) -> list:
    """All YAML documents of a text; a key that occurs twice in a mapping is an error."""
    import yaml

    class Loader(yaml.SafeLoader):
        pass

    def mapping(loader, node, deep=False):
        keys = [loader.construct_object(k, deep=True) for k, _ in node.value]
        if twice := {k for k in map(str, keys) if [str(x) for x in keys].count(k) > 1}:
            raise yaml.constructor.ConstructorError(None, None, f"duplicate keys {sorted(twice)}", node.start_mark)
        return dict(zip(keys, [loader.construct_object(v, deep=True) for _, v in node.value], strict=True))

    Loader.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, mapping)
    return [d for d in yaml.load_all(text, Loader=Loader) if d is not None]


def unwrap(value):
    """The value of {value, is_ai}, else as it is."""
    return value.get("value") if isinstance(value, dict) and set(value) == {"value", "is_ai"} else value


def detect_version(package: dict) -> str:
    raw = package.get("raw")
    found = package.get("schema_version") or (raw.get("schema_version") if isinstance(raw, dict) else None) or "1.0"
    if str(found) not in VERSIONS:
        raise ValueError(f"unknown schema version {found}")
    return str(found)


def misshapen(value, shape, path: str = "root") -> list[str]:
    """Where a value differs from a shape."""
    if isinstance(shape, dict):
        if not isinstance(value, dict):
            return [f"{path}: no mapping"]
        found = [f"{path}.{k}: missing" for k in sorted(shape.keys() - value.keys())] + [f"{path}.{k}: unexpected" for k in sorted(map(str, value.keys() - shape.keys()))]
        return found + [x for k in sorted(shape.keys() & value.keys()) for x in misshapen(value[k], shape[k], f"{path}.{k}")]
    if isinstance(shape, list):
        return [x for i, v in enumerate(value) for x in misshapen(v, shape[0], f"{path}[{i}]")] if isinstance(value, list) else [f"{path}: no list"]
    if shape == "ai":
        if not isinstance(value, dict) or set(value) != {"value", "is_ai"}:
            return [f"{path}: no value with is_ai"]
        return [f"{path}.value: no text"] * (value["value"] is not None and not isinstance(value["value"], str)) + [f"{path}.is_ai: no flag"] * (not isinstance(value["is_ai"], bool))
    ok = {"any": True, "text": isinstance(value, str), "text!": isinstance(value, str) and value.strip() != "", "flag": isinstance(value, bool), "none": value is None}[shape]
    return [] if ok else [f"{path}: not {shape}"]


def issues_of(package: dict) -> list[str]:
    """What is wrong with a package of its version: its shape, and then what values must be like."""
    try:
        version = detect_version(package)
    except ValueError as e:
        return [str(e)]
    if version == "1.0":
        own = {k: v for k, v in package.items() if k in FLAT}
        found = misshapen(own, FLAT)
        found += [f"root.{k}: no list" for k in FLAT_LISTS if k in package and not isinstance(package[k], list)]
        return found + [f"root.{k}: not text" for k in FLAT_TEXTS if k in package and not isinstance(package[k], str)]
    found = misshapen(package, PACKAGE if version == "2.0" else NESTED_PACKAGE)
    if not package.get("documents"):
        found.append("root.documents: empty")
    if found:
        return found
    if version == "2.0":
        found = [f"root.validation.status: {package['validation']['status']}"] * (package["validation"]["status"] not in STATUSES)
        for i, d in enumerate(package["documents"]):
            found += [f"root.documents[{i}].raw.{k}: {d['raw'][k]}" for k, ok in (("schema_version", str(d["raw"]["schema_version"]) == "2.0"), ("extraction_status", d["raw"]["extraction_status"] in STATUSES)) if not ok]
        return found
    source = package["source"]
    if bool(source["source_path"]) == bool(source["source_url"]):
        found.append("root.source: one of source_path and source_url")
    if not source["content_hash"].startswith("sha256:"):
        found.append("root.source.content_hash: no sha256")
    ids = []
    for i, r in enumerate(source["resources"]):
        path = f"root.source.resources[{i}]"
        found += misshapen(r, {"resource_id": "text!", "kind": "text", "raw": "any"}, path) or misshapen(r["raw"], RESOURCE.get(r["kind"], {}), f"{path}.raw")
        if isinstance(r, dict):
            ids.append(r.get("resource_id"))
            found += [f"{path}.kind: {r.get('kind')}"] * (r.get("kind") not in RESOURCE)
            if r.get("kind") == "link" and isinstance(r.get("raw"), dict) and r["raw"].get("criticality") not in LEVELS:
                found.append(f"{path}.raw.criticality: {r['raw'].get('criticality')}")
    found += ["root.source.resources: repeated ids"] * (len(set(map(str, ids))) < len(ids))
    for i, d in enumerate(package["documents"]):
        found += [f"root.documents[{i}].use.category: {d['use']['category']['value']}"] * (d["use"]["category"]["value"] not in CATEGORIES)
        found += [f"root.documents[{i}].use.description: too long"] * (len(d["use"]["description"]["value"] or "") > MOST_DESCRIPTION)
    return found


def signature_text(value) -> str:
    """A signature that is a string, {code}, or a list of either (its first)."""
    value = unwrap(value)
    if isinstance(value, list):
        return signature_text(value[0]) if value else ""
    if isinstance(value, dict):
        return str(value.get("code") or "")
    return "" if value is None else str(value)


def records_of(text: str) -> list[dict]:
    """Flat records of single, multi-document, list and ``documents:`` YAML."""
    out = []
    for loaded in load_unique(text):
        for package in loaded if isinstance(loaded, list) else [loaded]:
            if not isinstance(package, dict):
                raise ValueError("a document is no mapping")
            nested = package.get("documents")
            source = {k: unwrap(v) for k, v in (package.get("source") or {}).items()} if isinstance(package.get("source"), dict) else {}
            for d in nested if isinstance(nested, list) else [package]:
                version = detect_version(package)
                out.append(nested_record(d, source) if version == "2.1" and isinstance(d.get("use"), dict) else flat(d, source, version))
    return out


def nested_record(document: dict, source: dict) -> dict:
    """The record of a nested document: the version becomes a segment of the namespace, sections become the body."""
    name, namespace, version, use = (str(document.get(k) or "").strip() if k != "use" else document[k] for k in ("name", "namespace", "version", "use"))
    if not (name and namespace and version):
        raise ValueError("a document without name, namespace or version")
    identity = namespace if version in namespace.split(".") else f"{namespace}.{version}"
    short = re.sub(r"[^0-9A-Za-z_.-]+", "_", name).strip("_") or name
    text = lambda v: str(unwrap(v) or "").strip()
    texts = lambda vs: [t for t in map(text, vs or []) if t]
    details = use.get("function_details") or {}
    inputs, outputs = details.get("input_parameters") or [], details.get("output_parameters") or []
    tables = [(title, parameters_markdown(ps)) for title, ps in (("Input parameters", inputs), ("Output parameters", outputs), ("Fields", (use.get("data_structure") or {}).get("fields") or [])) if ps]
    sections = [("Description", text(use.get("description"))), ("Signature", text(details.get("signature"))), *tables, ("Prerequisites", "\n".join(texts(use.get("prerequisites")))), ("Examples", "\n\n".join(texts(use.get("examples"))))]
    return {
        "id": f"{identity}.{short}", "namespace": identity, "api_id": f"{identity}.{name}", "name": name, "version": version, "kind": text(use.get("category")) or "function", "language": str(document.get("language") or "cpp").strip(),
        "description": text(use.get("description")), "signature": text(details.get("signature")), "parameters_md": "\n\n".join(t for title, t in tables if title != "Fields"), "returns_json": json.dumps(outputs, ensure_ascii=False, sort_keys=True) if outputs else "",
        "examples": texts(use.get("examples")), "source": source.get("source_url") or source.get("source_path") or "", "content_hash": hashlib.sha256(json.dumps(document, ensure_ascii=False, sort_keys=True, default=str).encode()).hexdigest(),
        "title": f"{name} {identity} {text(use.get('summary'))}".strip(), "body": "\n\n".join([f"# {name}", *(f"#### {title}\n{body}" for title, body in sections if body)]),
        "version_support": [str(p["product"]) for p in use.get("product_support") or [] if isinstance(p, dict) and p.get("product") and p.get("supported")],
    }


def flat(document: dict, source: dict, schema_version: str) -> dict:
    text = lambda k: str(unwrap(document.get(k)) or "").strip()
    namespace, version, name = text("namespace"), text("version"), text("name")
    if version and version not in namespace.split("."):
        namespace = f"{namespace}.{version}" if namespace else version
    short = re.sub(r"[^a-z0-9_]", "", name.split("(", 1)[0].lower()) if schema_version != "2.1" else re.sub(r"[^A-Za-z0-9_-]", "", name.split("(", 1)[0])
    examples = [signature_text(e) for e in unwrap(document.get("examples")) or [] if signature_text(e).strip()]
    returns = unwrap(document.get("returns"))
    return {
        "id": text("chunk_id") or f"{namespace}.{short}", "namespace": namespace, "api_id": text("api_id") or f"{namespace}.{name}", "name": name, "version": version or namespace.rsplit(".", 1)[-1],
        "kind": text("kind"), "language": text("language"), "description": text("description"), "signature": signature_text(document.get("signature") or document.get("signatures")),
        "parameters_md": parameters_markdown(unwrap(document.get("parameters")) or []), "returns_json": json.dumps(returns, ensure_ascii=False, sort_keys=True) if returns else "",
        "examples": examples, "source": source.get("source_url") or source.get("source_path") or "", "content_hash": hashlib.sha256(json.dumps(document, ensure_ascii=False, sort_keys=True, default=str).encode()).hexdigest(),
        "title": text("title") or name, "body": text("body_md"), "version_support": [str(p["product"]) for p in unwrap(document.get("product_support")) or [] if isinstance(p, dict) and p.get("product") and p.get("supported")],
    }


def parameters_markdown(parameters: list) -> str:
    cell = lambda v: str(unwrap(v) or "").replace("|", "\\|").replace("\n", " ")
    rows = [f"| {cell(p.get('name'))} | {cell(p.get('type'))} | {cell(p.get('description'))} |" for p in parameters if isinstance(p, dict)]
    return "\n".join(["| name | type | description |", "| --- | --- | --- |", *rows]) if rows else ""


RECORD = "id string, namespace string, api_id string, name string, version string, kind string, language string, description string, signature string, parameters_md string, returns_json string, examples array<string>, source string, content_hash string, title string, body string, version_support array<string>"


def parse(files: DataFrame) -> DataFrame:
    """(path, record columns, error) of YAML files (path, text); a file that can't be parsed is one row with its error."""
    names = [c.split()[0] for c in RECORD.split(", ")]

    def of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for path, text in zip(part["path"], part["text"], strict=True):
                try:
                    out += [(path, *(r[n] for n in names), None) for r in records_of(text)]
                except Exception as e:  # whatever a document holds, it is its own error
                    out.append((path, *[None] * len(names), f"{type(e).__name__}: {str(e)[:200]}"))
            yield pd.DataFrame(out, columns=["path", *names, "error"])

    return files.select("path", "text").mapInPandas(of, f"path string, {RECORD}, error string")


def validate(files: DataFrame) -> DataFrame:
    """(path, issues) of YAML packages."""

    def of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for path, text in zip(part["path"], part["text"], strict=True):
                try:
                    found = [i for p in load_unique(text) for i in (issues_of(p) if isinstance(p, dict) else ["NOT_A_MAPPING"])]
                except Exception:
                    found = ["NOT_YAML"]
                if len(text.encode()) > MOST_STORED:
                    found.append("TOO_LARGE")
                out.append((path, found))
            yield pd.DataFrame(out, columns=["path", "issues"])

    return files.select("path", "text").mapInPandas(of, "path string, issues array<string>")


def project(records: DataFrame, ingested_at: Column) -> DataFrame:
    """Records as rows of the vector table's scalar columns, with the defaults of absent values."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    given = {c: text(c) for c in ("id", "namespace", "api_id", "name", "kind", "language", "description", "signature", "parameters_md", "returns_json") if c in records.columns}
    found = records.select(*[e.alias(c) for c, e in given.items()], *[c for c in records.columns if c not in given and c in ("examples", "deprecated", "source_markdown", "deprecation_note", "version", "version_support")])
    rest = {"examples": F.array().cast("array<string>"), "version_support": F.array().cast("array<string>"), "deprecated": F.lit(False), "source_markdown": F.lit(""), "deprecation_note": F.lit("")}
    found = found.withColumns({c: F.coalesce(F.col(c), e) if c in found.columns else e for c, e in rest.items()})
    version = F.coalesce(F.nullif(F.col("version"), F.lit("")), version_of_namespace(F.col("namespace"))) if "version" in found.columns else version_of_namespace(F.col("namespace"))
    return found.withColumn("version", version).withColumn("api_name", display_api_name(F.col("api_id"))).withColumn("ingested_at", ingested_at)


def dense_text() -> Column:
    """What is embedded as a dense vector."""
    return F.trim(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("description", "api_name", "name")]))


def sparse_text() -> Column:
    """What is embedded as a sparse vector."""
    return F.trim(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("api_id", "signature", "name")]))


def ready(records: DataFrame) -> DataFrame:
    """Records with ok: six identity fields, the id made of namespace and name, the version a segment of the namespace."""
    fields = [F.trim(F.coalesce(c, F.lit(""))) != "" for c in ("id", "namespace", "name", "version", "kind", "language")]
    formula = F.lower("id") == F.lower(F.concat("namespace", F.lit("."), normalized_api_name(F.col("name"))))
    ok = formula & F.array_contains(F.split("namespace", "[.]"), F.col("version"))
    for f in fields:
        ok = ok & f
    return records.withColumn("ok", F.coalesce(ok, F.lit(False)))


def unique(records: DataFrame) -> DataFrame:
    """Records whose id occurs once."""
    return reject_duplicates(records, F.col("id"))


def stable_document_id(field: Column, value: Column) -> Column:
    return F.concat(F.lit("yaml:"), sha256(F.concat(field, F.lit(":"), value)))


def supported_products(products: Column) -> Column:
    """Names of array<struct(product, supported)> that are supported, in order."""
    return F.transform(F.filter(products, lambda p: F.coalesce(p["supported"], F.lit(False)) & (F.coalesce(p["product"], F.lit("")) != "")), lambda p: p["product"])


# The strict reader: one document a file, stable codes, and the payload as a VARIANT

# The codes of what a file can't be stored for.
READ_CODES = ["FILE_TOO_LARGE", "YAML_PARSE_ERROR", "YAML_DUPLICATE_KEY", "MULTI_DOCUMENT_YAML_NOT_SUPPORTED", "YAML_ROOT_NOT_MAPPING", "UNSUPPORTED_SCHEMA_VERSION", "SCHEMA_VALIDATION_ERROR", "BSON_ENCODING_ERROR", "BSON_DOCUMENT_TOO_LARGE"]
READ = "struct<json: string, code: string, message: string>"


def _read_one(text: str | None) -> tuple[str | None, str | None, str | None]:
    import yaml

    if text is None:
        return None, "YAML_PARSE_ERROR", "no UTF-8"
    try:
        loaded = list(load_unique(text))
        n = sum(1 for _ in yaml.compose_all(text, Loader=yaml.SafeLoader))
    except yaml.constructor.ConstructorError as e:
        return None, "YAML_DUPLICATE_KEY" if "duplicate keys" in str(e) else "YAML_PARSE_ERROR", str(e)[:200]
    except (yaml.YAMLError, ValueError, TypeError) as e:
        return None, "YAML_PARSE_ERROR", f"{type(e).__name__}: {str(e)[:200]}"
    if n != 1:
        return None, "MULTI_DOCUMENT_YAML_NOT_SUPPORTED", f"{n} documents"
    if not loaded or not isinstance(loaded[0], dict):
        return None, "YAML_ROOT_NOT_MAPPING", "the root is no mapping"
    package = loaded[0]
    payload = json.dumps(package, ensure_ascii=False, default=str)
    if "_id" in package:
        return payload, "SCHEMA_VALIDATION_ERROR", "root._id: unexpected"
    try:
        detect_version(package)
    except ValueError as e:
        return payload, "UNSUPPORTED_SCHEMA_VERSION", str(e)
    if issues := issues_of(package):
        return payload, "SCHEMA_VALIDATION_ERROR", "; ".join(issues)[:1000]
    if odd := _not_storable(package):
        return payload, "BSON_ENCODING_ERROR", odd
    return payload, None, None


def _not_storable(value, path: str = "root") -> str | None:
    """Where a value is that a document store has no type for: keys that aren't text, numbers of over 64 bits, dates without
    a time, sets."""
    if isinstance(value, dict):
        return next((f"{path}: key {k!r}" for k in value if not isinstance(k, str)), None) or next((odd for k, v in value.items() if (odd := _not_storable(v, f"{path}.{k}"))), None)
    if isinstance(value, list):
        return next((odd for i, v in enumerate(value) if (odd := _not_storable(v, f"{path}[{i}]"))), None)
    if isinstance(value, int) and not -(1 << 63) <= value < 1 << 63:
        return f"{path}: a number of over 64 bits"
    return None if value is None or isinstance(value, (str, int, float, bool, bytes, datetime.datetime)) else f"{path}: {type(value).__name__}"


def read_strict(files: DataFrame, most_bytes: int = 10 << 20) -> DataFrame:
    """(path, payload, schema_version, code, message) of YAML files (path, text; null: no UTF-8), one document each.

    ``payload`` is a VARIANT, made once from what Python has read; the version, and whatever is projected from a payload
    later, comes from it without Python (``at``). Files that are too long aren't read at all. A file with a code has
    its payload where there is one to look at.
    """

    @F.pandas_udf(READ)
    def read(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_read_one(t) for t in texts], columns=["json", "code", "message"], dtype=object)

    long = F.octet_length("text") > most_bytes
    found = files.select("path", long.alias("long"), read(F.when(~F.coalesce(long, F.lit(False)), F.col("text"))).alias("r"))
    too_long = F.coalesce(F.col("long"), F.lit(False))
    stored = F.octet_length("r.json") > MOST_STORED
    code = F.when(too_long, "FILE_TOO_LARGE").when(F.col("r.code").isNull() & F.coalesce(stored, F.lit(False)), "BSON_DOCUMENT_TOO_LARGE").otherwise(F.col("r.code"))
    message = F.when(too_long, F.lit(f"over {most_bytes} bytes")).otherwise(F.col("r.message"))
    held = found.select("path", F.when(~too_long, F.parse_json(F.col("r.json"))).alias("payload"), code.alias("code"), message.alias("message"))
    version = F.coalesce(at("$.schema_version"), at("$.raw.schema_version"), F.lit("1.0"))
    return held.select("path", "payload", F.when(F.col("payload").isNotNull(), version).alias("schema_version"), "code", "message")


def at(path: str, kind: str = "string", payload: str = "payload") -> Column:
    """A value of a payload; null where there is none of that kind."""
    return F.try_variant_get(F.col(payload), path, kind)


def identities(strict: DataFrame) -> DataFrame:
    """(path, ord, name, namespace, version, language) of the documents in the payloads that have no code, by version of schema."""
    fields = ("name", "namespace", "version", "language")
    good = strict.where("code IS NULL")
    single = good.where("schema_version = '1.0'").select("path", F.lit(0).alias("ord"), *[F.trim(at(f"$.{f}")).alias(f) for f in fields])
    many = good.where("schema_version <> '1.0'").select("path", F.posexplode(at("$.documents", "array<variant>")).alias("ord", "d"))
    return single.union(many.select("path", "ord", *[F.trim(at(f"$.{f}", payload="d")).alias(f) for f in fields]))
