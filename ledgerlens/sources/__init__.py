"""Readers, views over the driver tables, dataset switching and sinks."""

from ledgerlens.sources.csv import read_transactions, write_transactions_csv
from ledgerlens.sources.dataset import Dataset, open_dataset
from ledgerlens.sources.fixtures import read_table, tx, tx_fraud, tx_o, tx_raw
from ledgerlens.sources.tables import (
    TableMissing, jdbc_options, latest_n, read_db_table, to_json_records, write_json,
)

__all__ = [
    "read_transactions", "write_transactions_csv", "Dataset", "open_dataset",
    "read_table", "tx", "tx_fraud", "tx_o", "tx_raw",
    "TableMissing", "jdbc_options", "latest_n", "read_db_table", "to_json_records", "write_json",
]
