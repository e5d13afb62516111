"""One pass over the files for all scanners.

Texts are by far the largest input, so they are read (and archives unpacked)
once: rule hits, secrets, the few root files other checks need, and a short row
for each file leave together, and everything later starts from that table. It
is written by kind, so that a check reads its own rows only. No secret and no
text of an environment file is in it in the clear.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from argusframe.functions.text import mask_secret, path_extension
from argusframe.operators.deps import LOCK_FILES, PACKAGE_MANIFEST, REQUIREMENTS
from argusframe.operators.files import MAX_SCAN_BYTES, is_counted_path, is_scanned_path, is_secret_path
from argusframe.operators.rules import Rule
from argusframe.operators.sast import hit_line, rule_cases, scanned_extensions, with_scan_texts
from argusframe.operators.secrets import SECRET_RULES, SecretRule, secret_items
from argusframe.session import ensure_checkpoint_dir, remove_folder, shuffles_dropped  # noqa: F401

ROOT_FILES = (PACKAGE_MANIFEST, REQUIREMENTS, *LOCK_FILES, ".env", ".gitignore")
BROKEN = "archive is broken"
_FIELDS = {"rule_ord": "int", "line": "int", "seq": "int", "secret": "string", "content": "string"}
_ITEM = "struct<kind:string," + ",".join(f"{n}:{t}" for n, t in _FIELDS.items()) + ">"
EVIDENCE = "target_id string, path string, size_bytes bigint, rule_ord int, line int, seq int, secret string, content string, kind string"


def file_evidence(files: DataFrame, rules: Sequence[Rule], secrets: bool | Sequence[SecretRule] = True, max_bytes: int | None = MAX_SCAN_BYTES) -> DataFrame:
    """``(target_id, path, size_bytes, rule_ord, line, seq, secret, content,
    kind)`` by ``kind``:

    - ``file``: one for each file, ``line`` is 1 if the file counts, else 0;
    - ``broken``: a row without a path; ``content`` says why;
    - ``skipped``: a file too large for the rules (``max_bytes``, null: none is);
    - ``rule``, ``secret`` (masked) and ``root``. Of root files only manifests
      carry their text; an ignore list is cut down to whether it names ``.env``.
    """
    path = F.col("path")
    here = path.isNotNull()
    is_root = here & path.isin(*ROOT_FILES)
    wanted = here & path_extension(path).isin(*scanned_extensions(rules)) & is_scanned_path(path)
    small = F.lit(True) if max_bytes is None else F.coalesce(F.col("size_bytes") <= max_bytes, F.lit(False))
    nothing = F.array().cast(f"array<{_ITEM}>")

    def item(kind: str, **fields) -> Column:
        return F.struct(F.lit(kind).alias("kind"), *[fields.get(n, F.lit(None)).cast(t).alias(n) for n, t in _FIELDS.items()])

    texts = with_scan_texts(files.withColumn("scanned", wanted & small), F.col("scanned"))
    kept_text = F.when(path.isin(PACKAGE_MANIFEST, REQUIREMENTS), F.col("content")) \
        .when((path == ".gitignore") & F.contains("content", F.lit(".env")), ".env").when(path == ".gitignore", "")
    parts = [
        F.when(here, F.array(item("file", line=is_counted_path(path)))).otherwise(F.array(item("broken", content=F.coalesce("content", F.lit(BROKEN))))),
        F.when(is_root, F.array(item("root", content=kept_text))),
        F.when(wanted & ~small, F.array(item("skipped", content=F.lit(f"over {max_bytes} bytes, not searched by the code rules")))),
    ]
    cases = rule_cases(rules)
    if cases:
        hits = F.filter(F.array(*cases), lambda h: h.isNotNull())
        parts.append(F.when(F.col("scanned"), F.transform(hits, lambda h: item("rule", rule_ord=h["rule_ord"], line=hit_line(h["before"])))))
    chosen = SECRET_RULES if secrets is True else tuple(secrets or ())
    if chosen:
        found = F.when(here & is_secret_path(path), secret_items(chosen))
        parts.append(F.transform(found, lambda m: item("secret", rule_ord=m["rule_ord"], line=m["line"], seq=m["seq"], secret=mask_secret(m["secret"]))))
    items = F.concat(*[F.coalesce(p.cast(f"array<{_ITEM}>"), nothing) for p in parts])
    return texts.select("target_id", "path", "size_bytes", F.explode(items).alias("item")).select(
        "target_id", "path", "size_bytes", *[f"item.{n}" for n in _FIELDS], "item.kind")


def new_evidence_path(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/evidence-{uuid.uuid4().hex}"


def write_evidence(evidence: DataFrame, path: str) -> None:
    with shuffles_dropped(evidence.sparkSession):
        evidence.write.mode("overwrite").option("compression", "zstd").partitionBy("kind").parquet(path)


def read_evidence(spark: SparkSession, path: str) -> DataFrame:
    """Evidence of one write, or of all batches below a folder."""
    return spark.read.schema(EVIDENCE).option("recursiveFileLookup", False).parquet(path)
