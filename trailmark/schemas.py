"""Explicit schemas of all sources; nothing is inferred."""

# Column names and types of the wire formats.
LEDGER = "timestamp timestamp_ntz, wallet_address string, amount_btc double, direction string, input_count int, output_count int, counterparty_wallet string"
TRANSFER = "transaction_id string, timestamp timestamp_ntz, sender_wallet string, receiver_wallet string, amount_btc double, input_count int, output_count int"
OBSERVATION = "observation_id string, transaction_id string, wallet_address string, ip_address string, device_id string, user_agent string, network_type string, session_id string, geo_region string, observed_at timestamp_ntz, origin string, is_synthetic boolean"
RICH_SCALARS = "timestamp string, txid string, legacy_transaction_id string, sender_wallet string, receiver_wallet string, amount_btc double, fee_btc double, script_type string"
RICH_FLOW = "src_ip string, dst_ip string, src_port int, dst_port int, geo_country string, asn bigint, asn_org string"
RICH = f"{RICH_SCALARS}, input_addresses array<string>, input_amounts array<double>, output_addresses array<string>, output_amounts array<double>, {RICH_FLOW}"
RICH_CSV = f"{RICH_SCALARS}, input_addresses string, input_amounts string, output_addresses string, output_amounts string, {RICH_FLOW}"
RICH_XML = f"{RICH_SCALARS}, input_addresses struct<address: array<string>>, input_amounts struct<amount: array<double>>, output_addresses struct<address: array<string>>, output_amounts struct<amount: array<double>>, {RICH_FLOW}"
EXPLORER = (
    "txid string, status struct<confirmed: boolean, block_height: bigint, block_time: bigint>, "
    "vin array<struct<is_coinbase: boolean, prevout: struct<scriptpubkey_address: string, value: bigint>>>, "
    "vout array<struct<scriptpubkey_address: string, value: bigint>>"
)
