"""Tables: their log, their snapshots and their scans."""
