"""Jobs on the document engine, each with a command line and a small config file."""
