"""The binary interchange format: bits, header, options and the document codec."""
