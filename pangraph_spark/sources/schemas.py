"""Spark types of the graph messages and of the JSON documents.

Each message is listed by field in the notation ``name:type``; a type that begins with a capital is
another message.  Messages that contain themselves are cut at depth one: the inner one keeps only what
locates the full record.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Messages, their fields and the fields' types.
MESSAGES = {
    "Node": "sequence:string name:string id:long",
    "Edge": "from:long to:long from_start:boolean to_end:boolean overlap:int",
    "Edit": "from_length:int to_length:int sequence:string",
    "Position": "node_id:long offset:long is_reverse:boolean name:string",
    "Mapping": "position:Position edit:Edit* rank:long",
    "Path": "name:string mapping:Mapping* is_circular:boolean length:long",
    "Graph": "node:Node* edge:Edge* path:Path*",
    "AlignmentRef": "name:string",
    "Support": "quality:double forward:double reverse:double left:double right:double",
    "Genotype": "allele:int* is_phased:boolean likelihood:double log_likelihood:double log_prior:double log_posterior:double",
    "Locus": "name:string allele:Path* support:Support* genotype:Genotype* overall_support:Support allele_log_likelihood:double*",
    "Alignment": (
        "sequence:string path:Path name:string quality:binary mapping_quality:int score:int query_position:int "
        "sample_name:string read_group:string fragment_prev:AlignmentRef fragment_next:AlignmentRef is_secondary:boolean "
        "identity:double fragment:Path* locus:Locus* refpos:Position* read_paired:boolean read_mapped:boolean "
        "mate_unmapped:boolean read_on_reverse_strand:boolean mate_on_reverse_strand:boolean soft_clipped:boolean "
        "discordant_insert_size:boolean uniqueness:double correct:double secondary_score:int* fragment_score:double "
        "mate_mapped_to_disjoint_subgraph:boolean fragment_length_distribution:string time_used:double "
        "to_correct:Position correctly_mapped:boolean annotation:string"
    ),
    "Connection": "next:long score:int",
    "Subpath": "path:Path next:long* score:int connection:Connection*",
    "MultipathAlignment": (
        "sequence:string quality:binary name:string sample_name:string read_group:string subpath:Subpath* "
        "mapping_quality:int start:long* paired_read_name:string annotation:string"
    ),
    "KmerMatch": "sequence:string node_id:long position:int backward:boolean",
    "BasePileup": "ref_base:int num_bases:int bases:string qualities:binary",
    "NodePileup": "node_id:long base_pileup:BasePileup*",
    "EdgePileup": "edge:Edge num_reads:int num_forward_reads:int qualities:binary",
    "Pileup": "node_pileups:NodePileup* edge_pileups:EdgePileup*",
    "SnarlRef": "name:string",
    "Visit": "node_id:long snarl:SnarlRef backward:boolean name:string",
    "Snarl": (
        "type:string start:Visit end:Visit parent:SnarlRef name:string start_self_reachable:boolean "
        "end_self_reachable:boolean start_end_reachable:boolean directed_acyclic_net_graph:boolean"
    ),
    "SnarlTraversal": "visit:Visit* name:string",
    "LocationSupport": "support:Support edge:Edge node_id:long",
    "Translation": "from:Path to:Path",
}

# The three kinds of snarl by number.
SNARL_TYPES = ["UNCLASSIFIED", "ULTRABUBBLE", "UNARY"]

_SCALARS = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "double": T.DoubleType(), "binary": T.BinaryType()}


def message(name: str) -> T.StructType:
    """The struct type of a message."""
    fields = []
    for item in MESSAGES[name].split():
        field, kind = item.split(":")
        many = kind.endswith("*")
        kind = kind.rstrip("*")
        base = _SCALARS.get(kind) or message(kind)
        fields.append(T.StructField(field, T.ArrayType(base) if many else base))
    return T.StructType(fields)


# JSON ids and offsets are quoted by some producers and bare in others: text at the boundary takes both.
READ_JSON = (
    "name string, sequence string, mapping_quality int, score int, quality string, "
    "path struct<name:string, mapping:array<struct<position:struct<node_id:string, offset:string, is_reverse:boolean>, "
    "edit:array<struct<from_length:int, to_length:int, sequence:string>>, rank:string>>>"
)
VARIANT_JSON = "chromosome string, position bigint, reference string, alternative array<string>, id string, quality double, samples map<string, array<string>>"
VARIANT_DATA_JSON = "chromosome string, position bigint, reference string, alternative array<string>, samples map<string, map<string, string>>"
GRAPH_JSON = (
    "node array<struct<id:string, sequence:string, name:string>>, "
    "edge array<struct<`from`:string, `to`:string, from_start:boolean, to_end:boolean, overlap:int>>, "
    "path array<struct<name:string, mapping:array<struct<position:struct<node_id:string, offset:string, is_reverse:boolean>, rank:string>>>>"
)
ALIGNED_READ = "struct<read_name:string, sequence_length:int, mapping_position:bigint>"
REGION_JSON = f"map<string, struct<segments:array<struct<segment_id:string, paths:array<string>>>, variants:struct<{', '.join(f.replace(' ', ':', 1) for f in VARIANT_JSON.split(', ', 6))}>, aligned_reads:array<{ALIGNED_READ}>>>"
NODE_LIST_JSON = "struct<nodes:array<struct<id:string, sequence:string>>>"
NODE_MAP_JSON = "struct<nodes:map<string, struct<strand:string, sequence:string, length:int, start_offset:bigint>>>"
