"""Row types of the data model."""

#: One record of an append-only change log; missing numbers read as 0 and missing texts as ''.
MUTATION = (
    "seq long, epoch long, fence_token long, deployment_id string, resource string, kind string, path string, dest_path string, "
    "offset long, mode int, size long, content_hash string, prev_state_ref string, new_state_ref string, txn_id string, "
    "client_op_id string, payload string, ts string, replay_status string, entry_checksum string"
)
OBJECT = "path string, length long, content binary"
BLOCK = "path string, offset long, length int, hash string"
CATALOG = (
    "archive_id string, stored_at timestamp, target_name string, local_path string, root_digest string, epoch long, logical_bytes long, "
    "verified boolean, last_drill struct<receipt_id string, ran_at timestamp, duration_ms double, digest_ok boolean, error string>, object_uri string"
)
RECOVERY_POINT = "id string, created_at timestamp, epoch long, journal_position long, archive_path string, root_digest string, kind string, note string"
DEPLOYMENT = "deploy_id string, phase string, updated_at timestamp, writes_after_cutover long"
FENCE = "resource string, epoch long, token long, holder string"
EPOCH = "resource string, epoch long, updated_at timestamp, reason string"
EVENT = "schema_version int, event struct<at timestamp, deploy_id string, kind string, level string, message string, phase string, fields string>"
METRIC = "name string, value double, unit string, labels map<string,string>, ts timestamp"

#: Operation kinds that replay knows.
KINDS = ("create", "write", "rename", "delete", "chmod", "truncate")
