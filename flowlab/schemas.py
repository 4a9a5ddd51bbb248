"""Declared schemas and column lists of the flow tables."""

from __future__ import annotations

# Field names of a connection log line and the column groups derived from them.
LOG_FIELDS = [
    "ts", "uid", "id_orig_h", "id_orig_p", "id_resp_h", "id_resp_p", "proto", "service", "duration", "orig_bytes",
    "resp_bytes", "conn_state", "local_orig", "local_resp", "missed_bytes", "history", "orig_pkts", "orig_ip_bytes",
    "resp_pkts", "resp_ip_bytes",
]
CATEGORICAL = ["proto", "service", "conn_state"]
NUMERIC = ["duration", "orig_bytes", "resp_bytes", "missed_bytes", "orig_pkts", "orig_ip_bytes", "resp_pkts", "resp_ip_bytes"]
ENGINEERED = ["bytes_ratio", "pkts_ratio", "orig_bytes_per_pkt", "resp_bytes_per_pkt"]
FEATURES = NUMERIC + ENGINEERED
LABELS = ["label", "detailed_label", "label_binary", "label_phase"]

FLOW_TYPES = {
    "ts": "double", "scenario": "string", "split": "string",
    **{c: "string" for c in CATEGORICAL},
    **{c: "double" for c in NUMERIC + ENGINEERED},
    "label": "string", "detailed_label": "string", "label_binary": "bigint", "label_phase": "string",
}
PRED_SCHEMA = "scenario string, label_binary tinyint, y_pred tinyint, y_score float"
UNSW_LIKE_SCHEMA = (
    "id bigint, proto string, service string, dur double, spkts bigint, dpkts bigint, sbytes double, dbytes double, "
    "smean double, dmean double, attack_cat string, label int"
)
# The second domain's columns, categories first, then numbers in the file's order, then id and labels.
# Counts and flags are whole numbers, the rest are doubles.
UNSW_COLUMNS = [
    ("proto", "string"), ("service", "string"), ("state", "string"),
    ("dur", "double"), ("spkts", "bigint"), ("dpkts", "bigint"), ("sbytes", "bigint"), ("dbytes", "bigint"), ("rate", "double"),
    ("sttl", "bigint"), ("dttl", "bigint"), ("sload", "double"), ("dload", "double"), ("sloss", "bigint"), ("dloss", "bigint"),
    ("sinpkt", "double"), ("dinpkt", "double"), ("sjit", "double"), ("djit", "double"), ("swin", "bigint"), ("stcpb", "bigint"),
    ("dtcpb", "bigint"), ("dwin", "bigint"), ("tcprtt", "double"), ("synack", "double"), ("ackdat", "double"), ("smean", "bigint"),
    ("dmean", "bigint"), ("trans_depth", "bigint"), ("response_body_len", "bigint"), ("ct_srv_src", "bigint"), ("ct_state_ttl", "bigint"),
    ("ct_dst_ltm", "bigint"), ("ct_src_dport_ltm", "bigint"), ("ct_dst_sport_ltm", "bigint"), ("ct_dst_src_ltm", "bigint"),
    ("is_ftp_login", "bigint"), ("ct_ftp_cmd", "bigint"), ("ct_flw_http_mthd", "bigint"), ("ct_src_ltm", "bigint"), ("ct_srv_dst", "bigint"),
    ("is_sm_ips_ports", "bigint"), ("id", "bigint"), ("attack_cat", "string"), ("label", "int"),
]
UNSW_SCHEMA = ", ".join(f"{name} {kind}" for name, kind in UNSW_COLUMNS)
METRICS = ["accuracy", "precision_macro", "recall_macro", "f1_macro", "precision_attack", "recall_attack", "f1_attack"]
