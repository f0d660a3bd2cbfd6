"""Training-data pipeline operators (quality, dedup, packing, archives); a self-contained subpackage."""
