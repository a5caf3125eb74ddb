"""Source files to symbols, imports, exports, references, usages, network calls, chunks, issues and facts."""
