"""The document catalogue: deterministic rows, conditional queries, insert and soft delete."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.functions.predicates import Condition, chain
from siltbed.operators.grid import limited
from siltbed.schemas import DOCUMENTS

# Fixed values of the generated rows.
NAMES = (
    "Product Requirements Document", "Technical Specification", "User Manual", "API Documentation", "System Architecture Design", "Test Plan",
    "Project Proposal", "Budget Report", "Marketing Strategy", "Research Paper", "Compliance Guidelines", "Security Policy",
    "Employee Handbook", "Training Materials", "Release Notes", "Business Plan", "Financial Statement", "Quality Assurance Report",
    "Installation Guide", "Configuration Manual", "Troubleshooting Guide", "Meeting Minutes", "Contract Agreement", "Service Level Agreement",
)
DESCRIPTIONS = (
    "Comprehensive documentation outlining key features and requirements", "Detailed technical specifications for system implementation",
    "Step-by-step guide for end users and administrators", "Complete API reference with examples and best practices",
    "High-level architecture and design patterns documentation", "Testing procedures and validation criteria",
    "Strategic planning document for project execution", "Financial analysis and budget allocation details",
    "Marketing initiatives and target audience strategies", "In-depth research findings and recommendations",
    "Regulatory compliance and industry standards guide", "Information security protocols and procedures",
    "Company policies and employee guidelines", "Educational materials for staff development",
    "Software release information and change log", "Business objectives and operational strategies",
    "Financial performance and accounting records", "Quality metrics and improvement processes",
    "Setup instructions and deployment guidelines", "System configuration and customization options",
    "Common issues and resolution procedures", "Official record of discussions and decisions",
    "Legal agreement terms and conditions", "Service expectations and performance metrics",
)
KEYWORDS = (
    "documentation, requirements, specifications", "technical, architecture, design", "user guide, manual, instructions", "API, integration, endpoints",
    "security, compliance, policy", "testing, quality, validation", "business, strategy, planning", "financial, budget, reporting",
    "training, education, learning", "research, analysis, findings",
)
TAGS = (
    "important, reviewed, approved", "draft, in-progress, pending", "archived, reference, legacy", "confidential, internal, restricted",
    "public, external, published",
)
TYPES = ("PDF", "DOC", "DOCX", "PPT", "PPTX", "CSV", "JSON", "PNG")
SOURCES = ("uploaded by user", "crawled from https://example.com", "from app DocumentManager")
SCOPES = ("public", "private", "group-shared", "accessed-by-token")
STATUSES = ("active", "active", "active", "deleted", "suspended")
PROCESS = ("uploaded", "acked", "parsed", "processed")


def generate(numbers: DataFrame) -> DataFrame:
    """A catalogue row for each number (id, from 0), as of spark.range(n); each but its user_id follows from its number."""
    i = F.col("id")
    cycle = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (i % len(values) + 1).cast("int"))
    url = lambda kind, ext: F.format_string(f"https://storage.example.com/{kind}/%d.{ext}", i + 1)
    return numbers.select(
        (i + 1).alias("doc_id"),
        F.uuid().alias("user_id"),
        F.when(i < len(NAMES), cycle(NAMES)).otherwise(F.concat(cycle(NAMES), F.lit(" v"), (F.floor(i / len(NAMES)) + 1).cast("string"))).alias("doc_name"),
        F.format_string("%d_%d:%d", i * 137 % 90000 + 10000, i % 5 + 2020, i % 5 + 1).alias("doc_no"),
        cycle(DESCRIPTIONS).alias("doc_desc"),
        F.concat(F.lit("This document contains "), cycle(NAMES), F.lit(" with detailed information and guidelines.")).alias("doc_summary"),
        cycle(KEYWORDS).alias("doc_keywords"),
        cycle(TAGS).alias("doc_tags"),
        url("documents", "pdf").alias("file_url"),
        url("thumbnails", "png").alias("image_url"),
        cycle(TYPES).alias("doc_type"),
        cycle(SOURCES).alias("doc_source"),
        cycle(SCOPES).alias("doc_scope"),
        cycle(STATUSES).alias("doc_status"),
        cycle(PROCESS).alias("process_status"),
        *[F.lit(None).cast("timestamp_ntz").alias(c) for c in ("created_at", "updated_at")],
    )


def query(documents: DataFrame, conditions: list[Condition], limit: int = 0) -> DataFrame:
    """All conditions must hold; a limit that is not positive means none."""
    return limited(documents.where(chain(documents, [Condition(c.field, c.op, c.value, "AND", c.value_2) for c in conditions])), limit, "doc_id")


def insert(documents: DataFrame, rows: DataFrame) -> DataFrame:
    """documents with rows; a missing column is null, missing times are now, an unknown column raises."""
    if extra := set(rows.columns) - set(DOCUMENTS.names):
        raise ValueError(f"unknown columns {sorted(extra)}")
    now = {c: F.coalesce(rows[c], F.localtimestamp()) if c in rows.columns else F.localtimestamp() for c in ("created_at", "updated_at")}
    return documents.unionByName(rows.withColumns(now), allowMissingColumns=True)


def soft_delete(documents: DataFrame, doc_id: int) -> DataFrame:
    """documents with one marked deleted, now; raises LookupError if there is none of that id."""
    hit = F.col("doc_id") == doc_id
    if documents.where(hit).isEmpty():
        raise LookupError(f"no document {doc_id}")
    return documents.withColumns({
        "doc_status": F.when(hit, "deleted").otherwise(F.col("doc_status")), "updated_at": F.when(hit, F.localtimestamp()).otherwise(F.col("updated_at")),
    })


def create_if_absent(spark: SparkSession, path: str, schema) -> None:
    """An empty table at path, unless there is one already."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(path)
