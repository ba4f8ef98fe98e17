"""quillstone: document retrieval, grounded answering and corpus analytics as Spark DataFrame operators."""
