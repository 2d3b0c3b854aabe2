"""Fixed schemas of the tables and documents the library reads and writes."""

from __future__ import annotations

from pyspark.sql.types import StructType


def struct(ddl: str) -> StructType:
    """Parsed form of a schema; needs a running session."""
    return StructType.fromDDL(ddl)


CHUNK = ("doc_id string, chunk_index int, chunk_uid string, text string, source string, "
             "embedding array<float>, tenant string")
DOCUMENT_META = ("tenant string, doc_id string, title string, author string, category string, "
                     "original_filename string, file_extension string, mime_type string, size_bytes bigint, "
                     "chunks_count int, added_at timestamp")
TURN = ("id:string,timestamp:string,user_content:string,ai_content:string,"
            "thinking_steps:array<struct<step_type:string,title:string,description:string,timestamp:string>>,"
            "tool_calls:array<struct<tool_name:string,arguments:map<string,string>,result:string>>,"
            "metadata:map<string,string>,tokens_used:int,duration_ms:int")
SESSION_DOC = ("session_id string, tenant_uuid string, title string, created_at string, updated_at string, "
                   f"conversations array<struct<{TURN}>>, _corrupt string")
SERVER_RAW = ("command string, args array<string>, env map<string,string>, cwd string, url string, "
                  "headers map<string,string>, transport string, type string, description string, "
                  "disabled boolean, enabled boolean")
GRADING_DOC = (
    "summary struct<pass_rate:double,passed:int,failed:int,total:int>, timing struct<total_duration_seconds:double>, "
    "execution_metrics struct<total_tool_calls:int,output_chars:bigint,errors_encountered:int>, "
    "expectations array<struct<text:string,passed:boolean,evidence:string>>, "
    "user_notes_summary struct<uncertainties:array<string>,needs_review:array<string>,workarounds:array<string>>, "
    "_corrupt string")
TIMING_DOC = ("total_duration_seconds double, total_tokens bigint, _corrupt string")
MEMORY = ("tenant string, id string, content string, tags array<string>, created_at timestamp")
EVENT = ("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string")
DOCUMENT = ("doc_id bigint, text string, lang string, source string, n_chars bigint")

# Allowed user roles.
USER_ROLES = ["admin", "user", "guest"]
_STAMPS = "created_at timestamp, updated_at timestamp"
ACCOUNT_TABLES = {
    "tenants": ("id int, uuid string, name string, code string, description string, logo_url string, "
                    "contact_email string, contact_phone string, max_users int, max_storage_gb int, "
                    f"is_active boolean, {_STAMPS}, expired_at timestamp"),
    "users": ("id int, uuid string, username string, email string, hashed_password string, full_name string, "
                  "phone string, avatar_url string, department string, role string, is_active boolean, "
                  f"is_superuser boolean, tenant_id int, tenant_uuid string, {_STAMPS}, last_login_at timestamp, "
                  "refresh_token string, token_expire_at timestamp"),
    "api_keys": ("id int, tenant_id int, tenant_uuid string, name string, api_key string, secret_key string, "
                     "max_requests_per_day int, is_active boolean, used_requests_today int, last_used_at timestamp, "
                     f"{_STAMPS}, expired_at timestamp"),
}
