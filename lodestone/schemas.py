"""Record schemas, as DDL, and the fixed vocabularies of the knowledge graph."""

from __future__ import annotations

EVIDENCE = "ARRAY<STRUCT<chunk_id: STRING, page: INT>>"
PAGES = "source_file STRING, page INT, text STRING, n_invalid INT"
CHUNKS = "chunk_id STRING, paper_id STRING, source_file STRING, page BIGINT, chunk_index INT, token_start INT, token_end INT, token_count INT, char_start INT, char_end INT, text STRING"
CHUNK_COLUMNS = [c.split()[0] for c in CHUNKS.split(", ")]
FOCAL = "ARRAY<STRUCT<name: STRING, type: STRING, aliases: ARRAY<STRING>>>"
PROFILES = f"MAP<STRING, STRUCT<focal_entities: {FOCAL}>>"
ENTITY = f"STRUCT<name: STRING, type: STRING, aliases: ARRAY<STRING>, evidence: {EVIDENCE}>"
RELATION = f"STRUCT<source: STRING, type: STRING, target: STRING, evidence: {EVIDENCE}>"
CANONICAL_ENTITY = f"name STRING, type STRING, aliases ARRAY<STRING>, evidence {EVIDENCE}, source_files ARRAY<STRING>"
CANONICAL_RELATION = f"source_kind STRING, source STRING, relation STRING, target STRING, target_type STRING, evidence {EVIDENCE}, source_files ARRAY<STRING>"
RAW = f"source_file STRING, paper_id STRING, batch_number INT, chunk_ids ARRAY<STRING>, focal_entities {FOCAL}, entities ARRAY<{ENTITY}>, relations ARRAY<{RELATION}>"

# Entity types, relation types, the target types each relation allows, the rank of relations, and names that
# are too general or are tools.
ENTITY_TYPES = ["Method", "Model", "Concept", "Task", "Dataset", "Metric"]
RELATION_TYPES = ["INTRODUCES", "USES", "ADDRESSES", "EVALUATES_ON", "MEASURED_BY", "IMPROVES", "COMPARED_WITH", "PRODUCES", "SOLVES"]
TARGET_TYPES = {
    "INTRODUCES": ["Method", "Model"],
    "USES": ["Concept", "Method", "Model"],
    "ADDRESSES": ["Task"],
    "EVALUATES_ON": ["Dataset"],
    "MEASURED_BY": ["Metric"],
    "IMPROVES": ["Method", "Model"],
    "COMPARED_WITH": ["Method", "Model"],
    "PRODUCES": ["Concept", "Model"],
    "SOLVES": ["Concept", "Task"],
}
RELATION_RANK = {"USES": 0, "PRODUCES": 1, "ADDRESSES": 2, "SOLVES": 3, "EVALUATES_ON": 4, "MEASURED_BY": 5, "IMPROVES": 6, "COMPARED_WITH": 7}
FOCAL_TYPES = ["Method", "Model"]
IMPLEMENTATION_TOOLS = ["pytorch", "adam"]
GENERIC_DATASETS = ["surface reconstruction benchmarks", "3d scene", "garment"]
GENERIC_COMPARISONS = ["poisson-based methods"]

# Canonical names by lower-case spelling.
CANONICAL_NAMES = {
    "udf": "Unsigned Distance Field",
    "udfs": "Unsigned Distance Field",
    "unsigned distance field": "Unsigned Distance Field",
    "unsigned distance fields": "Unsigned Distance Field",
    "sdf": "Signed Distance Field",
    "sdfs": "Signed Distance Field",
    "signed distance field": "Signed Distance Field",
    "signed distance fields": "Signed Distance Field",
    "gwn": "Generalized Winding Number",
    "gwn fields": "Generalized Winding Number",
    "generalized winding number": "Generalized Winding Number",
    "generalized winding numbers": "Generalized Winding Number",
    "generalized winding number fields": "Generalized Winding Number",
    "voronoi diagram": "Voronoi Diagram",
    "voronoi diagrams": "Voronoi Diagram",
    "projection distance field": "Projection Distance Field",
    "projection distance fields": "Projection Distance Field",
    "bi-directional normal": "Bi-directional Normal",
    "bi-directional normals": "Bi-directional Normal",
    "heat method": "Heat Method",
    "cd": "Chamfer Distance",
    "chamfer distance": "Chamfer Distance",
    "f-score": "F-Score",
    "f score": "F-Score",
    "hausdorff distance": "Hausdorff Distance",
    "capudf": "CAP-UDF",
    "cap-udf": "CAP-UDF",
    "dmu df": "DM-UDF",
    "dmudf": "DM-UDF",
    "dm-udf": "DM-UDF",
    "scannet": "ScanNet",
    "mgn dataset": "MGN",
    "mgn": "MGN",
    "shapenet-car": "ShapeNet-Car",
    "shapenet car": "ShapeNet-Car",
    "shapenet cars": "ShapeNet-Car",
    "marching cubes algorithm": "Marching Cubes",
}

# Types of canonical names that override the vote.
TYPE_OVERRIDES = {
    "Unsigned Distance Field": "Concept",
    "Signed Distance Field": "Concept",
    "Generalized Winding Number": "Concept",
    "Voronoi Diagram": "Concept",
    "Projection Distance Field": "Concept",
    "Bi-directional Normal": "Concept",
    "Heat Method": "Method",
    "Chamfer Distance": "Metric",
    "F-Score": "Metric",
    "Hausdorff Distance": "Metric",
    "ScanNet": "Dataset",
    "MGN": "Dataset",
    "ShapeNet-Car": "Dataset",
    "VAD": "Method",
    "DCUDF2": "Method",
    "DM-UDF": "Method",
    "MPFs": "Method",
    "GeoUDF": "Method",
    "SuperUDF": "Method",
    "CAP-UDF": "Method",
}
