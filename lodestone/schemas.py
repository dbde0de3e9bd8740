"""Tables of the engine, as schemas."""

from __future__ import annotations

SCANNED = "path string, relative_path string, language string, content string"
PARSED = (
    "file string, language string, classes array<struct<name:string,line:int>>, functions array<struct<name:string,line:int>>, "
    "imports array<string>, function_calls array<string>, function_to_function_calls array<struct<caller:string,callee:string>>"
)
GIT_LOG = "hash string, author string, message string, timestamp long, files array<string>"
HEAD = "commit_hash string, author_email string, message string, timestamp long, author_name string"
REPOSITORIES = "repo_id string, name string, url string, path string, current_commit string, last_analyzed timestamp"
FILES = "repo_id string, path string, language string, content_hash string"
FILE_VERSIONS = "repo_id string, file_path string, hash string, commit_hash string, ts timestamp, author string"
SNAPSHOTS = "snapshot_id string, repo_id string, commit_hash string, created_at timestamp, total_files long, total_deps long, avg_coupling double, cycle_count long"
EDGES = "src string, dst string, type string"
CHUNKS = "id string, code string, metadata struct<file_path:string,language:string,num_classes:int,num_functions:int>, embedding array<float>"
