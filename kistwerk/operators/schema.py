"""Schemas of the relations, as DDL."""

PROBLEM = "struct<code:string,message:string,path:string,offset:bigint,op:string>"
WARNING = "struct<seq:int,code:string,message:string,node_path:string,offset:bigint,op:string,severity:string>"
ARTIFACT = (
    "struct<seq:int,id:string,kind:string,status:string,artifact_path:string,media_type:string,size:bigint,sha256:string,raw:binary,depth:int,parent_id:string,"
    f"children:int,source_node_id:bigint,ole_file_name:string,ole_source_path:string,ole_temp_path:string,error:{PROBLEM},note:string>"
)
REPORT = (
    "path string, size bigint, duration_ms bigint, success boolean, partial boolean, dedup_hits int, bytes_exported bigint, "
    f"artifacts array<{ARTIFACT}>, warnings array<{WARNING}>, error {PROBLEM}"
)
NODES = (
    "path string, node_id bigint, type string, node_path string, name string, parent_id bigint, size bigint, clsid binary, state_bits bigint, "
    "created_at bigint, modified_at bigint, child_count int, depth int, dfs_index int, bfs_index int"
)
STATS = "path string, artifact_total int, warning_total int, error_total int, node_total int, stream_total int, storage_total int, max_depth int"
PROPERTIES = (
    "path string, stream_path string, set_index int, format_id string, pid bigint, vt int, value_string string, value_long bigint, value_ulong decimal(20,0), "
    "value_bool boolean, value_ts timestamp, value_filetime decimal(20,0), value_bytes binary, raw binary, error string"
)
FILES = (
    "path string, size bigint, duration_ms bigint, success boolean, partial boolean, artifacts_total int, artifacts_ok int, artifacts_failed int, "
    "warnings int, error_code string, error_message string"
)
