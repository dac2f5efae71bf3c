"""Table shapes used across the package."""

from __future__ import annotations


# One source file per row.
SOURCE_FILES = "file_id string, repo string, path string, language string, content string, size_bytes long"

# One syntax node per row. ``pre`` and ``post`` bracket a subtree: a node lies
# inside another when its ``pre`` is between the other's ``pre`` and ``post``.
# ``sibling_ord`` counts all children of the parent from 0; lines count from 1;
# the root of a file has no parent.
SYNTAX_NODES = (
    "file_id string, language string, node_id long, parent_id long, sibling_ord int, pre long, post long, "
    "type string, start_line long, end_line long, text string"
)

COMMITS = "repo string, sha string, message string, committed_at timestamp"

COMMIT_MARK = "struct<sha:string,message:string,date:timestamp,marker_count:int,confidence:string,signals:array<string>>"

DIMENSION_COLUMNS = ("complexity_score", "duplication_score", "documentation_score", "error_handling_score")
SCORE_COLUMNS = ("debt_score", *DIMENSION_COLUMNS)

# Column types of a repository dataset. Files may hold any part of them.
REPOSITORY_TYPES = {
    "name": "string",
    "url": "string",
    "description": "string",
    "language": "string",
    "stars": "long",
    "forks": "long",
    "created_at": "timestamp",
    "updated_at": "timestamp",
    "size_kb": "long",
    "is_private": "boolean",
    "default_branch": "string",
    "ai_commit_sha": "string",
    "ai_commit_message": "string",
    "ai_commit_date": "timestamp",
    "ai_marker_count": "int",
    "ai_confidence": "string",
    "ai_signals": "array<string>",
    "total_commits_analyzed": "int",
    "ai_commits_found": "int",
    "ai_commit_ratio": "double",
    "ai_confidence_level": "string",
    "ai_commits": f"array<{COMMIT_MARK}>",
    "likely_ai_assisted": "boolean",
    "collected_at": "timestamp",
    "search_query": "string",
    "domain": "string",
    "repo_id": "int",
    "debt_score": "double",
    "complexity_score": "double",
    "duplication_score": "double",
    "documentation_score": "double",
    "error_handling_score": "double",
    "severity": "string",
    "type": "string",
    "source": "string",
    "analysis_method": "string",
    "files_analyzed": "int",
    "total_lines": "long",
}

# Column order of a history export.
HISTORY_COLUMNS = (
    "name",
    "url",
    "language",
    "debt_score",
    "complexity_score",
    "duplication_score",
    "documentation_score",
    "error_handling_score",
    "severity",
    "files_analyzed",
    "total_lines",
    "analysis_method",
    "created_at",
)

DEBT_RATINGS = "struct<complexity:int,duplication:int,documentation:int,error_handling:int>"
VERIFICATION = (
    "struct<ai_identification_score:int,ai_identification_confidence:int,"
    f"ai_identification_evidence:array<string>,debt_severity_scores:{DEBT_RATINGS},"
    "overall_debt_severity:int,comments:string,reviewed_at:string,reviewer_id:string>"
)
ANNOTATION_FILE = (
    "repositories array<struct<repo_id:int,name:string,url:string,language:string,size_kb:long,"
    f"ai_commit_ratio:double,ai_confidence_auto:string,verification:{VERIFICATION}>>"
)


