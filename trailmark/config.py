"""Constants of the domain, in one place."""

# Windows, caps, thresholds and weights of the analysis.
BURST_SECONDS = 3600
MIN_PERIOD_HOURS = 1.0
RATIO_CAP = 100.0
FOREST_TREES, CONTAMINATION, FOREST_SEED = 200, 0.10, 42
HIGH_PERCENTILE, LOW_PERCENTILE = 0.90, 0.10
FORENSIC_WEIGHT, ML_WEIGHT = 0.40, 0.60
HIGH_SHARE, MEDIUM_SHARE = 0.05, 0.20
MIN_SCORED_WALLETS = 20
RUN_HISTORY = 50
MANY_COUNTRIES, MANY_ASNS, USUAL_PORT = 3, 3, 8333
PEEL_SHARE, PEEL_HOPS = 0.85, 3
COINJOIN_INPUTS, COINJOIN_OUTPUTS, COINJOIN_TOLERANCE = 3, 3, 0.01
RISK_DECAY, RISK_HOPS, RISK_NODES, RISK_SEEDS = 0.5, 4, 200, 50
CONFIDENCE_COMBINED, CONFIDENCE_ENTITY, CONFIDENCE_FINDING, CONFIDENCE_PATTERN = 0.55, 0.15, 0.10, 0.20
SESSION_GAP_SECONDS = 7200
SENDER_COVERAGE, RECEIVER_COVERAGE = 0.8, 0.5
BALANCE_TOLERANCE_SATS = 1
MAX_BTC, SATOSHI = 21_000_000.0, 100_000_000
ID_PATTERN = r"^[A-Za-z0-9_.:\-]+$"
SCRIPT_TYPES = ("p2pkh", "p2sh", "p2wpkh", "p2wsh", "p2tr")
DOCUMENTATION_NETS = ("192.0.2.", "198.51.100.", "203.0.113.")

# The 18 features in order, and those that are null for wallets with one transfer.
FEATURES = (
    "transaction_count", "incoming_count", "outgoing_count", "total_received_btc", "total_sent_btc", "avg_transaction_amount",
    "time_since_previous_tx", "avg_transaction_interval", "transaction_frequency", "dormancy_duration", "activity_burst",
    "incoming_outgoing_ratio", "fan_in", "fan_out", "unique_counterparties", "wallet_degree", "repeated_connections", "hop_distance",
)

# The "high" rules in order (rule, feature, what it says); the imbalance rule comes last.
HIGH_RULES = (
    ("high_transaction_count", "transaction_count", "Relatively high transaction activity compared with other wallets"),
    ("high_transaction_frequency", "transaction_frequency", "Relatively high transaction frequency (transactions per day)"),
    ("activity_burst", "activity_burst", "Many transactions concentrated within a short (1-hour) period"),
    ("long_dormancy", "dormancy_duration", "Long inactivity period between consecutive transactions (dormant-period indicator, in hours)"),
    ("fan_out", "fan_out", "Funds are distributed across a relatively large number of outgoing connections"),
    ("fan_in", "fan_in", "Funds are received through a relatively large number of incoming connections"),
    ("many_counterparties", "unique_counterparties", "Interacts with a relatively large number of distinct counterparty wallets"),
    ("repeated_relationships", "repeated_connections", "Repeatedly transacts with the same counterparties more often than most wallets"),
    ("high_received_volume", "total_received_btc", "Relatively high total BTC received"),
    ("high_sent_volume", "total_sent_btc", "Relatively high total BTC sent"),
)
IMBALANCE_RULE = "incoming_outgoing_imbalance"
# What the imbalance rule says beyond either percentile; {} stand for the value and the percentile.
IMBALANCE_HIGH = "Strong incoming/outgoing imbalance: much more BTC received than sent (incoming_outgoing_ratio={}, capped at 100; population 90th percentile={})."
IMBALANCE_LOW = "Strong incoming/outgoing imbalance: much more BTC sent than received (incoming_outgoing_ratio={}; population 10th percentile={})."
# Evidence levels for 0, 1, 2-3 and 4 or more rules.
EVIDENCE_LEVELS = ("No specific rule triggered", "Single behavioural indicator", "Multiple behavioural indicators", "Multiple strong behavioural indicators")
RULES = (*(r for r, _, _ in HIGH_RULES), IMBALANCE_RULE)
SIGNAL_NOTE = "Investigative signal of a prototype; not statistically validated and no verdict."
