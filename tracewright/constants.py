"""Fixed values of the event model, the rules and the analysis. Results depend on them."""

from __future__ import annotations

#: Node types, edge types with their end points.
NODE_TYPES = ("PROC", "FILE", "NET", "SYSCALL", "PKG", "CRED")
EDGE_ENDS = {
    "EXEC": ("PROC", "PROC"),
    "READ": ("PROC", "FILE"),
    "WRITE": ("PROC", "FILE"),
    "CONNECT": ("PROC", "NET"),
    "INVOKE": ("PROC", "SYSCALL"),
    "DEPEND": ("PKG", "PKG"),
    "LOAD": ("PKG", "PROC"),
    "CAUSE": ("PROC", "PROC"),
    "REDIRECT": ("NET", "NET"),
    "RESOLVE": ("NET", "NET"),
    "RELAY": ("NET", "NET"),
    "INJECT": ("PROC", "PROC"),
    "DNS_QUERY": ("PROC", "NET"),
}

#: Default of each canonical attribute, by edge type and by node type.
EDGE_DEFAULTS = {
    "EXEC": {"cmdline": ""},
    "READ": {"bytes": 0},
    "WRITE": {"bytes": 0},
    "CONNECT": {"bytes_sent": 0, "bytes_recv": 0, "direction": ""},
    "INVOKE": {"args": "", "return_val": 0},
    "DEPEND": {"version_constraint": ""},
    "LOAD": {"entry_point": ""},
    "CAUSE": {"delta_t": 0.0, "cause_rule": "", "confidence": 1.0},
    "REDIRECT": {"http_status": 0},
    "RESOLVE": {"resolved_ip": ""},
    "RELAY": {"delta_t": 0.0},
    "INJECT": {"injection_type": ""},
    "DNS_QUERY": {"query_domain": ""},
}
NODE_DEFAULTS = {
    "PROC": {"is_lolbin": False, "parent_depth": 0},
    "FILE": {"path_sensitivity": 0, "file_type": ""},
    "NET": {"port": 0, "is_known_registry": False, "tls_valid": True},
    "SYSCALL": {},
    "PKG": {},
    "CRED": {"cred_type": ""},
}

#: Attack stages in their order; class 0 is "none".
STAGES = (
    "resource_development",
    "initial_access_delivery",
    "execution",
    "persistence_privilege_defense_evasion",
    "discovery_collection",
    "command_and_control",
    "exfiltration_impact",
)

#: Indicator types, the most specific first.
IOC_PRIORITY = (
    "data_exfiltration",
    "execution_chain",
    "execution",
    "process_injection",
    "package_name",
    "malicious_binary",
    "file_transfer",
    "file_artifact",
    "persistence",
    "defense_evasion",
    "crypto_indicator",
    "cloud_recon",
    "c2_agent",
    "suspicious_port",
    "dns_indicator",
    "attack_ip",
    "monitoring",
)

#: Stage of each indicator type.
IOC_STAGE = {
    "package_name": "resource_development",
    "cloud_recon": "resource_development",
    "monitoring": "resource_development",
    "malicious_binary": "initial_access_delivery",
    "file_artifact": "initial_access_delivery",
    "file_transfer": "initial_access_delivery",
    "execution": "execution",
    "execution_chain": "execution",
    "process_injection": "execution",
    "persistence": "persistence_privilege_defense_evasion",
    "defense_evasion": "persistence_privilege_defense_evasion",
    "crypto_indicator": "persistence_privilege_defense_evasion",
    "attack_ip": "command_and_control",
    "c2_agent": "command_and_control",
    "dns_indicator": "command_and_control",
    "suspicious_port": "command_and_control",
    "data_exfiltration": "exfiltration_impact",
}

#: Stage of each ATT&CK tactic.
TACTIC_STAGE = {
    "resource-development": "resource_development",
    "reconnaissance": "resource_development",
    "initial-access": "initial_access_delivery",
    "execution": "execution",
    "persistence": "persistence_privilege_defense_evasion",
    "privilege-escalation": "persistence_privilege_defense_evasion",
    "defense-evasion": "persistence_privilege_defense_evasion",
    "credential-access": "discovery_collection",
    "discovery": "discovery_collection",
    "collection": "discovery_collection",
    "lateral-movement": "discovery_collection",
    "command-and-control": "command_and_control",
    "exfiltration": "exfiltration_impact",
    "impact": "exfiltration_impact",
}

#: Indicator types that never label a stage in rule modes.
NETWORK_IOC_TYPES = ("attack_ip", "suspicious_port", "dns_indicator", "c2_agent")

#: The default weak rules (a rule file may replace them).
RULES = {
    "version": 2,
    "rule_type_to_ioc_type": {
        "suricata_alert": "attack_ip",
        "lolbin_bitsadmin": "execution",
        "lolbin_certutil": "execution",
        "lolbin_encoded_ps": "defense_evasion",
        "lolbin_download_cradle": "execution_chain",
        "inject_edge": "process_injection",
        "suspicious_port": "suspicious_port",
        "tier2_pipe_to_shell": "execution_chain",
    },
    "rank_policy": {
        "require_ioc_log_source_for_high": True,
        "min_rule_types_for_high": 2,
        "strong_rule_types_single_hit": ["suricata_alert", "inject_edge", "lolbin_encoded_ps", "tier2_pipe_to_shell"],
        "exclude_rule_types": ["tier2_setup_py_install", "tier2_pip_user_target", "tier2_npm_postinstall", "tier2_docker_remote_fetch"],
        "lolbin_download_single_flag_max_confidence": "medium",
    },
    "tier1": {
        "suricata_source_suffixes": ["eve.json"],
        "suricata_cmdline_markers": ["et ", "suricata", "alert"],
        "lolbin_flags": {
            "has_bitsadmin": "lolbin_bitsadmin",
            "has_certutil": "lolbin_certutil",
            "has_base64_flag": "lolbin_encoded_ps",
            "has_invoke_expression": "lolbin_encoded_ps",
            "has_invoke_webrequest": "lolbin_download_cradle",
            "has_curl": "lolbin_download_cradle",
            "has_wget": "lolbin_download_cradle",
        },
        "lolbin_requires_second_flag_for_high": ["has_curl", "has_wget", "has_invoke_webrequest"],
        "inject_edge_types": ["INJECT"],
        "connect_edge_types": ["CONNECT", "RELAY", "REDIRECT"],
        "suspicious_ports": [2121, 4444, 5000, 50000, 8081, 8443, 9001],
    },
    "tier2_cmdline_patterns": [
        {"id": "tier2_pipe_to_shell", "pattern": r"(?i)(?:curl|wget)\s+[^|]+\|\s*(?:ba)?sh", "confidence": "high", "rank_eligible": True},
    ],
}

#: Patterns of text signals; group 0 counts unless said otherwise.
URL = r"\bhttps?://[^\s\"'<>]+"
DOMAIN = r"\b(?:(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?)\.)+(?:[a-z]{2,63})\b"
MD5 = r"\b[a-f0-9]{32}\b"
SHA1 = r"\b[a-f0-9]{40}\b"
SHA256 = r"\b[a-f0-9]{64}\b"
CLOUD_SECRET = r"\b(DefaultEndpointsProtocol|AccountKey|SharedAccessKey)\b"
JWT = r"\beyJ[a-zA-Z0-9_-]{10,}\.[a-zA-Z0-9_-]{10,}\.[a-zA-Z0-9_-]{10,}\b"
BASE64 = r"\b[A-Za-z0-9+/]{80,}={0,2}\b"
REGISTRIES = ("pypi.org", "files.pythonhosted.org", "npmjs.org", "registry.npmjs.org", "github.com", "raw.githubusercontent.com")
IP = r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b"
WINDOWS_PATH = r"\b[A-Za-z]:\\[^\s\"']+"
UNIX_PATH = r"(?:^|[\s\"'])(/[^ \t\n\r\"']+)"  # group 1
COMMAND_FLAGS = {
    "has_powershell": r"\bpowershell(\.exe)?\b",
    "has_bitsadmin": r"\bbitsadmin(\.exe)?\b",
    "has_certutil": r"\bcertutil(\.exe)?\b",
    "has_curl": r"\bcurl\b",
    "has_wget": r"\bwget\b",
    "has_base64_flag": r"(?:-enc|-encodedcommand)\b",
    "has_invoke_webrequest": r"\binvoke-webrequest\b",
    "has_invoke_expression": r"\binvoke-expression\b|\biex\b",
}

#: Layout of an edge's feature vector.
FEATURE_NUMBERS = ("bytes_sent", "bytes_recv", "bytes", "delta_t")
FEATURE_FLAGS = (
    "has_powershell", "has_bitsadmin", "has_certutil", "has_curl", "has_wget", "has_base64_flag", "has_invoke_webrequest",
    "has_invoke_expression", "has_jwt", "has_base64_blob", "has_azure_secret_hint", "has_known_registry_domain",
)
FEATURE_CATEGORIES = ("method", "status_code", "proto", "service", "tls_version", "tls_cipher", "sni", "cause_rule")
FEATURE_BUCKETS = 8

#: Log names of the audit family.
AUDIT_FILES = ("azure_conn.csv", "azure_process.csv", "azure_events.csv", "azure_syslog.csv")
FAMILY_ALIASES = {"all": "full", "azure": "audit", "ids": "eve", "suricata": "eve"}
FAMILIES = ("full", "audit", "zeek", "eve")

#: The known scenarios and their log files, all of which carry indicators.
SCENARIO_FILES = {
    "sc1": ("windows/azure_events.csv", "windows/azure_conn.csv", "windows/azure_process.csv"),
    "sc2": ("azure_events.csv",),
    "sc3": ("eve.json", "azure_syslog.csv", "zeek_conn.csv", "zeek_dns.csv", "zeek_http.csv"),
    "sc4": ("eve.json", "azure_syslog.csv", "zeek_conn.csv", "zeek_dns.csv", "zeek_ssl.csv"),
    "sc5": ("azure_events.csv",),
    "sc6": ("victim/azure_events.csv",),
    "sc7": ("eve.json", "zeek_conn.csv", "zeek_http.csv", "zeek_files.csv"),
}
