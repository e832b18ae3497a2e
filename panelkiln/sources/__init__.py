"""Reading and writing: panels, labels, inventories, ledgers, corpora."""
