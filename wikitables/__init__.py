"""Wiki corpora as Spark tables: index, diff, plan, fetch and convert pages to Markdown."""
