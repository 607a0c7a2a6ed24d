"""DataFrame to DataFrame operators over citations."""
