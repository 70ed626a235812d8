"""quillspark: catalogue, retrieval, monitoring and text-data operators expressed as Spark plans."""
