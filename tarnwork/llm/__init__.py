"""Training-data operators (licences, repeats, packing, media, archives, quality, shards, mixing, joins)."""
