"""Sources and sinks: XML, JSON and binary documents as event tables."""
