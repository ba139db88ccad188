"""Group commit of submitted files."""
