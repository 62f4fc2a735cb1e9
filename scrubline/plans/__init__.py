"""Jobs over whole tables: profile, plan, verify, contract, diff, inject, score."""
